"""Operator 10: document fingerprints by randomised edit embedding.

A random walk goes through the characters of a text: at each time step the current character is written out, and a random
bit that all texts share for (time, character) decides whether the walk goes on to the next one. An edit shifts the walk,
which then meets the other text's walk again after few steps, so edit distance becomes Hamming distance between what the
walks write. Only the time that a walk reaches after each character is kept, as what it writes follows from that.

The fingerprint samples SAMPLES times of the walk. Sample k looks at the last of its record times before the walk's end;
record times are drawn like the records of a random sequence, so the last one is uniform over the walk, and two walks of
about equal length look at the same times. Each sample is BITS hashed bits of the character there. Likeness is the share of
equal samples. ``similar`` bands the samples, joins equal bands and verifies by likeness over all samples.

Texts of a batch walk in step, one character of every text at a time; the few longest finish alone.

Nulls: a null text is empty; all empty texts have one fingerprint. Null ids follow all others, in the order of a hash
bucket, then of the text. Rows of equal id follow each other by text. A single row is its own next. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, partitions_for, ready_workers, stored, table, tidy
from .components import components
from .simhash import band_pairs

SAMPLES = 128
BITS = 4
#: Of ``similar``: the likeness that links, and the bands of samples that make candidates.
ALIKE, BANDS = 0.8, 16
SEED = 10
#: Character classes and times of the shared random bits; both repeat beyond that.
CLASSES, PERIOD = 64, 4096
BATCH_CHARS = 6 << 20
RANGES = 8
ALONE = 48  # so few texts left walk one by one
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lru_cache(maxsize=1)
def stays() -> np.ndarray:
    """[class, time]: the steps that the walk spends on a character of the class that it reaches at the time."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    bits[:, -1] = True
    nxt = np.zeros((CLASSES, PERIOD), np.int32)
    ahead = np.where(bits[:, :64].any(1), bits[:, :64].argmax(1), 63) + PERIOD
    for t in range(PERIOD - 1, -1, -1):
        ahead = np.where(bits[:, t], t, ahead)
        nxt[:, t] = ahead - t + 1
    return nxt


@lru_cache(maxsize=1)
def records() -> np.ndarray:
    """[sample, i]: the record times of each sample, ascending, beyond the length of any text."""
    rng, rows = np.random.default_rng(SEED + 1), []
    for _ in range(SAMPLES):
        p, row = 1, []
        while p < 1 << 40:
            row.append(p - 1)
            p = int(p / (1 - rng.random())) + 1
        rows.append(row)
    out = np.full((SAMPLES, max(map(len, rows))), 1 << 62, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)


def walk(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, time: np.ndarray) -> np.ndarray:
    """The time after each character. starts, sizes: the texts' places in codes; time: when each walk begins."""
    cls, table_, out = classes(codes), stays(), np.zeros(len(codes), np.int32)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts, time = sizes[order], starts[order], time[order].astype(np.int64)
    left = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    flat, i = table_.ravel(), 0
    for i, n in enumerate(left.tolist()):
        if n < ALONE:
            break
        at = starts[:n] + i
        t = time[:n]
        t += flat[(cls[at].astype(np.int64) * PERIOD) + (t & (PERIOD - 1))]
        out[at] = t
    else:
        return out
    rows, mask = [r.tobytes() for r in table_.astype(np.uint8)], PERIOD - 1
    for a, n, t in zip((starts + i)[: left[i]].tolist(), (sizes - i)[: left[i]].tolist(), time[: left[i]].tolist(), strict=True):
        own = []
        for c in cls[a : a + n].tobytes():
            t += rows[c][t & mask]
            own.append(t)
        out[a : a + n] = own
    return out


def sample(codes: np.ndarray, times: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[text, sample]: the hashed bits of the characters at the sampled times; zeros for an empty text."""
    full = sizes > 0
    starts, n = starts[full], sizes[full]
    end = times[starts + n - 1].astype(np.int64)
    at = np.empty((len(n), SAMPLES), np.int64)
    for k, row in enumerate(records()):
        at[:, k] = row[np.searchsorted(row, end) - 1]
    low, high = np.zeros_like(at), np.broadcast_to((n - 1)[:, None], at.shape).copy()
    while (low < high).any():  # the first character whose time is over the sampled one
        mid = (low + high) >> 1
        over = times[starts[:, None] + mid] > at
        high, low = np.where(over, mid, high), np.where(over, low, mid + 1)
    found = codes[starts[:, None] + low].astype(np.uint64)
    mixed = (found + np.uint64(1)) * (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros((len(full), SAMPLES), np.uint8)
    out[full] = (mixed >> np.uint64(64 - BITS)).astype(np.uint8)
    return out


def spans(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))[:-1]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def embed(texts: list[str]) -> np.ndarray:
    """The samples of each text."""
    codes, sizes = code_points(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    return sample(codes, walk(codes, spans(sizes), sizes, np.zeros(len(texts), np.int64)), spans(sizes), sizes)


def embed_edited(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Samples of each text; of each text but the last with its second half replaced by the next one's head; those; sizes."""
    codes, sizes = code_points(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    starts = spans(sizes)
    times = walk(codes, starts, sizes, np.zeros(len(texts), np.int64))
    own = sample(codes, times, starts, sizes)
    size, start = sizes[:-1], starts[:-1]
    half = size // 2
    keep, new = size - half, np.minimum(half, sizes[1:])
    tails = np.concatenate([np.arange(0)] + [codes[a : a + n] for a, n in zip(starts[1:].tolist(), new.tolist(), strict=True)]).astype("<u4")
    begun = np.where(keep > 0, times[np.maximum(start + keep - 1, 0)] if len(times) else 0, 0)
    tail_times = walk(tails, spans(new), new, begun)
    total, tail_at = keep + new, spans(new)
    edited, edited_times = np.empty(total.sum(), "<u4"), np.empty(total.sum(), np.int32)
    for a, k, s, t, n in zip(spans(total).tolist(), keep.tolist(), start.tolist(), tail_at.tolist(), new.tolist(), strict=True):
        edited[a : a + k], edited_times[a : a + k] = codes[s : s + k], times[s : s + k]
        edited[a + k : a + k + n], edited_times[a + k : a + k + n] = tails[t : t + n], tail_times[t : t + n]
    others = [x[:k] + y[:n] for x, y, k, n in zip(texts[:-1], texts[1:], keep.tolist(), new.tolist(), strict=True)]
    return own, sample(edited, edited_times, spans(total), total), others, sizes


def written(samples: np.ndarray) -> list[str]:
    packed = samples[:, ::2] << 4 | samples[:, 1::2]
    return [row.tobytes().hex() for row in packed]


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each bucket ends with a tail row, the first of the next bucket, that gives no row of its own."""
    ids: list = []
    texts: list[str] = []

    def out():
        own, edited, others, sizes = embed_edited(texts)
        names, n = written(own), len(texts) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], pa.int64()),
                pa.array(sizes[:n]),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in others], pa.string()),
                pa.array(names[:n], pa.string()),
                pa.array(written(edited), pa.string()),
                pa.array((own[:-1] == edited).mean(1)),
                pa.array((own[:-1] == own[1:]).mean(1)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held = 0
    for b in batches:
        for doc_id, text, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if tail or held > BATCH_CHARS:
                if len(texts) > 1:
                    yield out()
                ids, texts = ([], []) if tail else (ids[-1:], texts[-1:])
                held = sum(map(len, texts))


def fingerprints(docs: DataFrame) -> DataFrame:
    """OUT for every row of docs (doc_id, text), in descending order of ids: see the module's docstring.

    Ids are cut into ranges, several for each task; a task gets ranges that follow each other and hold its share of the bytes.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    parts = partitions_for(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    wide = rows.withColumn("_at", F.col("doc_id").cast("double"))
    n = RANGES * parts
    cuts = sorted(set(wide.approxQuantile("_at", [i / n for i in range(1, n)], 0.25 / n))) or [0.0]
    bucketed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_at", outputCol="_b", handleInvalid="keep").transform(wide)
    nulls = -1 - F.pmod(F.xxhash64("text"), F.lit(n))
    bucketed = bucketed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), nulls).otherwise(F.col("_b").cast("long")).alias("bucket"))
    # A row for each range, of a number that is set by the partitions.
    heads = bucketed.groupBy("bucket").agg(F.max("doc_id").alias("first"), F.sum(F.octet_length("text") + 64).alias("bytes")).collect()
    heads = sorted(heads, reverse=True, key=lambda r: r["bucket"])
    total, before, plan = sum(r["bytes"] for r in heads), 0, []
    for r, after in zip(heads, heads[1:] + heads[:1], strict=True):
        plan.append((r["bucket"], r["first"], before * parts // total, after["bucket"]))
        before += r["bytes"]
    ranges = F.broadcast(spark.createDataFrame(plan, "bucket long, first long, part int, next long"))
    found = bucketed.join(ranges, "bucket")
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("bucket").agg(F.min("text").alias("text"))
    tails = firsts.withColumnRenamed("bucket", "next").join(ranges, "next").select(F.lit(None).cast("long").alias("doc_id"), "text", "bucket", "part", F.lit(True).alias("tail"))
    every = found.select("doc_id", "text", "bucket", "part", F.lit(False).alias("tail")).unionByName(tails)
    every = every.repartitionById(parts, "part").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    return every.select("doc_id", "text", "tail").mapInArrow(neighbours, OUT)


def likeness(u: str, v: str):
    """The share of equal samples of two columns of fingerprints."""
    digits = F.sequence(F.lit(1), F.lit(SAMPLES * BITS // 4))
    return F.aggregate(digits, F.lit(0), lambda n, i: n + (F.substring(u, i, F.lit(1)) == F.substring(v, i, F.lit(1))).cast("int")) / SAMPLES


@tidy
def similar(prints: DataFrame, least: float = ALIKE, bands: int = BANDS) -> DataFrame:
    """doc_id, fingerprint, similar_id for every row of prints (doc_id, fingerprint): classes of documents alike by their samples.

    Distinct fingerprints that are equal in a whole band are candidates, verified by their likeness over all samples; linked
    ones are a class, named by its smallest doc_id (NULL if none has an id). A pair at likeness 0.8 shares one of 16 bands of
    8 samples with a probability of 0.95, one at 0.9 of 0.9998. Of a band that very many fingerprints share, each is compared
    with two of them, others in each band, so no group's pairs are all made.
    """
    width = SAMPLES * BITS // 4 // bands
    prints = prints.select("doc_id", "fingerprint")
    one = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("fingerprint", i * width + 1, F.lit(width))))
    one = stored(one.select("fingerprint", "least", "n", keys.alias("keys"), F.monotonically_increasing_id().alias("uid")))
    of = lambda c: one.select(F.col("uid").alias(c), F.col("fingerprint").alias(f"print_{c}"))
    linked = band_pairs(one).join(of("u"), "u").join(of("v"), "v").where(likeness("print_u", "print_v") >= least)
    member = components(linked.select("u", "v"))
    rooted = one.join(member, one.uid == member.node, "left").select("fingerprint", "n", "least", F.coalesce("root", "uid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("similar_id"))
    classes = stored(rooted.join(names, "root").select("fingerprint", "n", "similar_id"))
    return hot_join(prints, classes, "fingerprint", "n", classes.agg(F.sum("n")).first()[0] or 0).select("doc_id", "fingerprint", "similar_id")


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(written(embed(b.column("text").to_pylist())), pa.string())], ["doc_id", "fingerprint"])


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by its edit embedding: fingerprints banded, joined and verified."""
    ready_workers(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return similar(stored(docs.mapInArrow(printed, "doc_id long, fingerprint string")))


def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op10_edit_embedding": op10_edit_embedding, "edit_similar_documents": similar_documents}
ORACLE_SQL: dict[str, str] = {}
