"""Operator 5: token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range partitioned and sorted by id (or by another order), encoded, an end id added, and written, one ORC
file a range: ``doc_id, part, at, ids``. The ids are an ORC integer column (run-length encoding version 2, bit-packed);
stripes are split points for parallel readers; row indexes and a Bloom filter on doc_id let a reader skip stripes and row
groups from metadata. Token offsets come from the files: each range's total first, then within the range.

Nulls: a null text is empty (the end id alone); null ids sort first, in the order they are read. Rows of equal id follow each other by text. Empty
table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, pieces, ready_workers, stored, table, trimmed
from .pretokens import NOT_PLAIN, tokenizer, vocabulary
from .word_bytes import WordIds

END_ID = 2
#: Words that a worker remembers the ids of before it starts anew.
REMEMBERED = 700_000
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1024",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
FILE_COLUMNS = "doc_id long, part int, at int, ids array<int>"


@lru_cache(maxsize=2)
def remembered(path: str) -> WordIds:
    return WordIds(REMEMBERED)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else the next beyond Latin-1."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


_LETTERS = _byte_letters()


def encode_batch(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text as the library gives them without special tokens added; plain texts by their words' bytes."""
    t = tokenizer(path)
    model = t.model
    tokens = lambda word: [x.id for x in model.tokenize(word.decode("latin-1").translate(_LETTERS))]
    plain = ["<|" not in x and NOT_PLAIN.search(x) is None for x in texts]
    known = iter(remembered(path).encode([x.lower().encode() for x, p in zip(texts, plain, strict=True) if p], tokens))
    out = [next(known) if p else None for p in plain]
    # One by one: what the library holds for a text is many times its ids.
    for i in [i for i, ids in enumerate(out) if ids is None]:
        out[i] = np.array(t.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, "<u4")
    return out


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at, last = TaskContext.get().partitionId(), 0, np.array([end], "<u4")
    for b in pieces(batches):
        ids = encode_batch(b.column("text").to_pylist(), path)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
        flat = np.concatenate([last[:0], *(x for a in ids for x in (a, last))])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat.view(np.int32)))
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int32)), lists], ["doc_id", "part", "at", "ids"])
        at += n


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        off, raw = np.asarray(ids.offsets, np.int64), memoryview(np.ascontiguousarray(np.asarray(ids.values, "<i4"))).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("at"), pa.array(np.diff(off)), pa.array(crc)], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str | None = None, end: int = END_ID, order: list[str] | None = None) -> DataFrame:
    """Encodes docs (doc_id, text), writes the ORC files, and returns them as they read back (FILE_COLUMNS)."""
    path = path or vocabulary("word_bpe_49k.json")
    spark = docs.sparkSession
    ready_workers(spark)
    order = order or ["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order) if c != "doc_id"])
    by = ["doc_id" if c == "doc_id" else f"_{i}" for i, c in enumerate(order)]
    # Rows without an id could be many, and would be one range: they are told apart by where they are read.
    rows = rows.withColumn("_tie", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    by.append("_tie")
    rows = rows.repartitionByRange(partitions_for(docs), *by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    return stored(rows.mapInArrow(lambda it: trimmed(encoded(it, path, end)), FILE_COLUMNS), "orc", **ORC)


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: a start is the number of ids of all documents before."""
    rows = files.mapInArrow(lambda it: trimmed(checksums(it)), "doc_id long, part int, at int, n_tokens long, ids_crc32 long")
    rows = stored(rows)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(totals.select("part", "_before"), "part")
    return rows.select("doc_id", (F.col("_before") + F.col("_own")).alias("start"), "n_tokens", "ids_crc32", "part")


def lookup(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; stripes and row groups without them are skipped by the Bloom filters and indexes."""
    return files.where(F.col("doc_id").isin(doc_ids))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, in ascending doc_id order."""
    return token_index(write_tokens(table(spark, sf_dir, "documents"))).drop("part")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of docs in the order of its rows in its files, so that they keep the mix; docs not from files: by id."""
    order = ["_metadata.file_path", "_metadata.row_index"]
    try:
        placed = docs.select("doc_id", "text", F.col(order[0]).alias("_file"), F.col(order[1]).alias("_row"))
    except AnalysisException:
        return token_index(write_tokens(docs)).drop("part")
    return token_index(write_tokens(placed, order=["_file", "_row"])).drop("part")


QUERIES = {"op5_token_files": op5_token_files}
ORACLE_SQL: dict[str, str] = {}
