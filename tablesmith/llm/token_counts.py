"""Operator 2: token counts from pre-tokens, each distinct one counted once, no ids of documents materialised.

1. A block is a few Arrow batches of documents (bounded in rows and bytes). Its texts are split into pre-tokens, and the
   block's per-document frequencies are turned around: for each distinct pre-token, the documents that hold it and how often.
   Pre-tokens that are themselves an entry of the vocabulary (a table bounded by the vocabulary's size) and those that a
   1/HOT part of the block's documents share are settled in the block, so that no very common one crosses the network.
2. The rest are hash partitioned and sorted by pre-token. All rows of a pre-token follow each other in one task, which counts
   its pieces once and joins the count to its frequencies; what leaves the task is a sum for each document of a block.
3. Sums are partitioned and sorted by block, and added block by block.

No task remembers more than a batch, a block, or the sums of OPEN_BLOCKS blocks, however large its partition is.

A text with a special string is split there first, as the library does by default; each such string is one token.
Nulls: a null text is empty (0 bytes, 0 tokens); a null id keeps its row. Repeated rows each get a row. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, ready_workers, table
from .pretokens import byte_pretokens, tokenizer, vocabulary

HOT = 64
ORD_BITS = 12
MOST = (1 << (32 - ORD_BITS)) - 1
OPEN_BLOCKS = 512
BLOCK_BYTES = 16 << 20


class Ids(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pieces(words: list[str], path: str) -> np.ndarray:
    """How many pieces each pre-token has."""
    return np.fromiter((len(e.ids) for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)), np.int64, len(words))


@lru_cache(maxsize=2)
def entries(path: str) -> dict[str, int]:
    """Pieces of every vocabulary entry that is whole text; no more than the vocabulary has."""
    t = tokenizer(path)
    words = [w for i in range(t.get_vocab_size(False)) if (w := t.decode([i], skip_special_tokens=False)) and "�" not in w]
    return dict(zip(words, pieces(words, path).tolist(), strict=True))


@lru_cache(maxsize=2)
def specials(path: str) -> tuple[str, ...]:
    return tuple(sorted((a.content for a in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True))


def segments(text: str, marks: tuple[str, ...]) -> list[str]:
    """The parts of a text between special strings."""
    parts = [text]
    for m in marks:
        if m in text:
            parts = [q for p in parts for q in p.split(m)]
    return parts


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to BLOCK_BYTES or 2**ORD_BITS rows."""
    held, rows, size = [], 0, 0
    for b in batches:
        for part in (b.slice(i, 1 << ORD_BITS) for i in range(0, b.num_rows, 1 << ORD_BITS)):
            if held and (rows + part.num_rows > 1 << ORD_BITS or size + part.nbytes > BLOCK_BYTES):
                yield pa.concat_batches(held)
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
    if held:
        yield pa.concat_batches(held)


def invert(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Step 1: a row with the documents of each pre-token of a block, and one with the block's documents (no pre-token)."""
    from pyspark import TaskContext

    known, marks = entries(path), specials(path)
    for at, b in enumerate(blocks(batches)):
        n = b.num_rows
        block = (TaskContext.get().partitionId() << 32) | at
        seen, found, base = Ids(), [], np.zeros(n, np.int64)
        for i, text in enumerate(b.column("text").to_pylist()):
            parts = segments(text, marks)
            base[i] = len(parts) - 1
            words = byte_pretokens(parts[0], path) if len(parts) == 1 else [w for p in parts for w in byte_pretokens(p, path)]
            found.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        words = list(seen)
        ords = np.repeat(np.arange(n), [len(x) for x in found])
        pair, freq = np.unique((np.concatenate(found) << ORD_BITS) | ords, return_counts=True)
        word, ords = pair >> ORD_BITS, pair & ((1 << ORD_BITS) - 1)
        own = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        hot = np.flatnonzero((np.bincount(word, minlength=len(words)) >= max(32, n / HOT)) & (own == 0))
        if len(hot):
            own[hot] = pieces([words[i] for i in hot], path)
        base += np.bincount(ords, own[word] * freq, n).astype(np.int64)
        keep = own[word] == 0
        word, ords, freq = word[keep], ords[keep], freq[keep]
        while len(big := np.flatnonzero(freq > MOST)):  # an entry has MOST at most: several entries for more
            word, ords, freq = np.append(word, word[big]), np.append(ords, ords[big]), np.append(freq, freq[big] - MOST)
            freq[big] = MOST
            order = np.argsort(word, kind="stable")
            word, ords, freq = word[order], ords[order], freq[order]
        rows, start = np.unique(word, return_index=True)
        offsets = np.append(start, len(word)).astype(np.int32) * 4
        entry = ((freq << ORD_BITS) | ords).astype("<u4").tobytes()
        texts = [words[i] for i in rows]
        docs = b.column("doc_id")
        info = np.stack([np.asarray(docs.fill_null(0)), np.asarray(docs.is_valid()), np.asarray(b.column("n_bytes")), base]).astype("<i8").tobytes()
        payload = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entry)])
        keys = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in texts), np.uint32, len(texts)).view(np.int32)
        names = ["block", "key", "pretoken", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([block % 0x7FFFFFFF], pa.int32()), pa.array([None], pa.string()), pa.array([info], pa.binary())], names)
        for i in range(0, len(rows), 1 << 16):
            s = slice(i, i + (1 << 16))
            part = payload.slice(i, 1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(keys[s]), pa.array(texts[s], pa.string()), part], names)


def joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Step 2: counts each pre-token of this partition once; sums by (block, document). Rows come sorted by pre-token."""
    counts: dict[str, int] = {}
    sums: dict[int, np.ndarray] = {}
    schema = pa.schema([("block", pa.int64()), ("docs", pa.bool_()), ("payload", pa.binary())])

    def flush():
        blocks, data = list(sums), []
        for v in sums.values():
            i = np.flatnonzero(v)
            data.append(np.stack([i, v[i]]).astype("<i8").tobytes())
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([False] * len(blocks)), pa.array(data, pa.binary())], schema=schema)

    for b in batches:
        words, blocks, payloads = b.column("pretoken").to_pylist(), b.column("block").to_pylist(), b.column("payload").to_pylist()
        own = [w for w in dict.fromkeys(words) if w is not None]
        new = [w for w in own if w not in counts]
        # Only the last pre-token of a batch can go on in the next.
        counts = {w: counts[w] for w in own if w in counts} | dict(zip(new, pieces(new, path).tolist() if new else [], strict=True))
        info = [i for i, w in enumerate(words) if w is None]
        if info:
            yield pa.RecordBatch.from_arrays([pa.array([blocks[i] for i in info], pa.int64()), pa.array([True] * len(info)), pa.array([payloads[i] for i in info], pa.binary())], schema=schema)
            skip = set(info)
            words, blocks, payloads = ([x for i, x in enumerate(c) if i not in skip] for c in (words, blocks, payloads))
        if not words:
            continue
        entry = np.frombuffer(b"".join(payloads), "<u4")
        of, which = np.unique(np.array(blocks, np.int64), return_inverse=True)
        size = np.fromiter(map(len, payloads), np.int64, len(payloads)) // 4
        n = np.repeat(np.fromiter(map(counts.__getitem__, words), np.int64, len(words)), size)
        cell = (np.repeat(which, size) << ORD_BITS) | (entry & ((1 << ORD_BITS) - 1)).astype(np.int64)
        got = np.bincount(cell, n * (entry >> ORD_BITS), len(of) << ORD_BITS).astype(np.int64).reshape(len(of), -1)
        for k, v in zip(of.tolist(), got, strict=True):
            sums[k] = sums[k] + v if k in sums else v
        if len(sums) > OPEN_BLOCKS:
            yield flush()
    if sums:
        yield flush()


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the documents of each block with their sums. Rows come sorted by block; a block is no larger than in step 1."""
    at, info, sums = None, None, np.zeros(1 << ORD_BITS, np.int64)

    def out():
        ids, valid, n_bytes, base = info
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(n_bytes), pa.array(base + sums[: len(base)])], ["doc_id", "n_bytes", "n_tokens"])

    for b in batches:
        for block, is_docs, payload in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "payload")), strict=True):
            if block != at:
                if at is not None:
                    yield out()
                at, info = block, None
                sums[:] = 0
            if is_docs:
                info = np.frombuffer(payload, "<i8").reshape(4, -1)
            else:
                i, v = np.frombuffer(payload, "<i8").reshape(2, -1)
                np.add.at(sums, i, v)
    if at is not None:
        yield out()


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text). path: a byte-level tokenizer file."""
    path = path or vocabulary("byte_bpe_50k.json")
    spark = docs.sparkSession
    ready_workers(spark)
    parts = partitions_for(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.mapInArrow(lambda it: invert(it, path), "block long, key int, pretoken string, payload binary")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "pretoken").mapInArrow(lambda it: joined(it, path), "block long, docs boolean, payload binary")
    rows = rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(added, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
