"""Operator 9: benchmark decontamination by a prefix-filtered set join with exact verification.

Windows of an item are its runs of WINDOW words (the whole item if it is shorter). A window is the set of its word
shingles (five words, fewer in shorter windows). All shingles share one order, by rarity in the corpus, then by hash. As a
window must be contained whole, its necessary prefix is its rarest shingle alone; a window of which any shingle is absent
from the corpus is dropped at once. Candidates are the places of prefix shingles in documents (hash join). The window must
then start within the document (positional bound), end within it (length bound), and its words must be equal (exact check).

One pass reads the texts. It keeps the places of shingles that a bit table says may be in the benchmark, each with the few
words around it that any window there could cover, so the texts aren't needed again. The table has 64 bits a shingle, up to
TABLE_BITS in all; it is made by an aggregate and reaches the driver as no more than TABLE_BITS / 64 numbers. False positives
find no partner in the join; with a benchmark of far more than TABLE_BITS shingles there are more of them, and results stay.

What a document has hit travels as the number of an item set (the items that share a window), never as lists of items: the
digest of items is made once for each distinct combination of sets, not for each document.

Nulls: a null text or item text has no words; null item ids don't count as items, but hit; null doc ids keep their rows.
Repeated items of one id count once, repeated documents each have a row. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, hot_join, pieces, ready_workers, stored, table, tidy, trimmed, utf8

WINDOW = 10
SHINGLE = 5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CLEAN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if _WORD[c] else 32 for c in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], "<u8")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "<u8")


class Words:
    """The words of many texts: bytes, starts and ends, hashes, and the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.clean = raw.tobytes().translate(_CLEAN)
        inside = _WORD[np.frombuffer(self.clean, np.uint8)]
        first = np.zeros(len(inside) + 1, bool)
        first[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.of = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.of)
        at8 = np.ndarray((len(self.clean) + 8,), "<u8", self.clean + bytes(16), strides=(1,))
        size = self.ends - self.starts
        head = at8[self.starts] & _MASK[np.minimum(size, 8)]
        tail = np.where(size > 8, at8[np.maximum(self.ends - 8, 0)], 0)
        self.hashes = _mix(head * _K[0] ^ _mix(tail + size.astype("<u8") * _K[2]))

    def shingles(self, length: int) -> np.ndarray:
        """The hash of the shingle that starts at each word; meaningless where it would leave its text."""
        h = self.hashes
        out = np.full(max(0, len(h) - length + 1), length, "<u8")
        for i in range(length):
            out = _mix(out * _K[1] + h[i : i + len(out)])
        return out

    def words(self, a: int, b: int) -> str:
        return " ".join(self.clean[x:y].decode("utf-8", "surrogatepass") for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K[0]
    return x ^ (x >> np.uint64(29))


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each item, with its shingles in order."""
    for b in batches:
        w = Words(*utf8(b.column("text")))
        by_length = {k: w.shingles(k).view("<i8") for k in range(1, SHINGLE + 1)}
        ids, texts, sizes, parts = [], [], [], []
        for i, item in enumerate(b.column("item_id").to_pylist()):
            a, n = int(w.of[i]), int(w.n[i])
            size = min(WINDOW, n)
            k = min(SHINGLE, size)
            for at in range(a, a + n - size + 1) if n else ():
                ids.append(item)
                texts.append(w.words(at, at + size))
                sizes.append(size)
                parts.append(by_length[k][at : at + size - k + 1].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["item", "window", "size", "shingles"])


def places(batches: Iterator[pa.RecordBatch], lengths: list[int], table_) -> Iterator[pa.RecordBatch]:
    """Each document's number of words, and the places of shingles that may be the benchmark's."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    hit_type = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("near", pa.string())])
    for b in batches:
        w = Words(*utf8(b.column("text")))
        last = np.repeat(w.of[1:], w.n)  # the end of each word's text
        doc = np.repeat(np.arange(b.num_rows), w.n)
        hits: list[list[dict]] = [[] for _ in range(b.num_rows)]
        for k in lengths:
            h = w.shingles(k)
            found = np.flatnonzero(table_.value.maybe(h))
            for at in found[found + k <= last[found]].tolist():
                d = int(doc[at])
                a, z = int(w.of[d]), int(w.of[d + 1])
                low, high = max(a, at - WINDOW + k), min(z, at + WINDOW)
                hits[d].append({"h": int(h[at].view("<i8")), "at": at - a, "low": low - a, "near": w.words(low, high)})
        rows = np.arange(row, row + b.num_rows)
        row += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(rows), b.column("id"), pa.array(w.n), pa.array(hits, pa.list_(hit_type))], ["row", "id", "n_words", "hits"])


PLACES = "row long, id {}, n_words long, hits array<struct<h:long,at:int,low:int,near:string>>"


def _item_sets(windows_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, size, shingles, set) of distinct windows, and (set, item): the items that share a window have one set's number."""
    distinct = windows_.groupBy("window", "size", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items"))
    distinct = distinct.withColumn("set", F.md5(F.to_json("items")))
    return distinct.drop("items"), distinct.select("set", F.explode("items").alias("item")).distinct()


@tidy
def _judged(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 for every row of rows (id of any type, text without nulls)."""
    spark = rows.sparkSession
    ready_workers(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.mapInArrow(lambda it: trimmed(windows(pieces(it))), "item string, window string, size int, shingles array<long>")
    distinct, sets = map(stored, _item_sets(stored(items)))
    shingles = distinct.select("window", "size", "set", F.posexplode("shingles").alias("offset", "h"))
    table_ = spark.sparkContext.broadcast(bit_table(shingles, "h"))  # of bounded size
    lengths = sorted(r[0] for r in distinct.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # SHINGLE at most
    rows = stored(rows.mapInArrow(lambda it: trimmed(places(pieces(it), lengths, table_)), PLACES.format(dict(rows.dtypes)["id"])))
    hits = rows.where(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("p")).select("row", "n_words", "p.*")
    # Rarity of the benchmark's shingles in the corpus; absent ones rule their windows out.
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("rarity"))
    ranked = shingles.join(rarity, "h", "left").groupBy("window", "size", "set")
    prefix = ranked.agg(F.min_by(F.struct("h", "offset", "rarity"), F.struct("rarity", "h", "offset")).alias("p"), F.count_if(F.col("rarity").isNull()).alias("absent"))
    prefix = stored(prefix.where("absent = 0").select("window", "size", "set", "p.*"))
    start = F.col("at") - F.col("offset")
    n_places = rows.agg(F.sum(F.size("hits"))).first()[0] or 0
    found = hot_join(hits, prefix, "h", "rarity", n_places).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    inside = F.array_join(F.slice(F.split("near", " "), start - F.col("low") + 1, F.col("size")), " ")
    found = found.where(inside == F.col("window")).select("row", start.alias("a"), (start + F.col("size")).alias("z"), "set")
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "z"))).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    seen = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        seen,
        lambda s, x: F.struct(F.greatest(s["upto"], x["z"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["upto"], x["a"]))).cast("long").alias("n")),
        lambda s: s["n"],
    )
    by_row = stored(by_row.select("row", covered.alias("n_hit"), "sets", F.md5(F.array_join("sets", ",")).alias("combination")))
    # Each combination of sets is turned into items and their digest once.
    combined = by_row.groupBy("combination").agg(F.first("sets").alias("sets"), F.count(F.lit(1)).alias("rows"))
    digest = combined.select("combination", "rows", F.explode("sets").alias("set")).join(sets, "set", "left").groupBy("combination", "rows")
    digest = digest.agg(F.array_sort(F.collect_set("item")).alias("items"))
    digest = stored(digest.select("combination", "rows", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    by_row = hot_join(by_row.select("row", "n_hit", "combination"), digest, "combination", "rows", by_row.count())
    out = rows.select("row", "id", "n_words").join(by_row, "row", "left")
    none = F.lit(0).cast("long")
    return out.select("id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text)."""
    out = _judged(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), benchmark)
    return out.withColumnRenamed("id", "doc_id").withColumn("contaminated", F.col("n_hit") > 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item. A row is decided by its text alone, whatever ids it shares."""
    key = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    found = _judged(docs.select(key.alias("id"), F.coalesce("text", F.lit("")).alias("text")), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("n_hit > 0").select(F.col("id").alias("key")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(gone, "key", "left_anti").select("row.*")


QUERIES = {"op9_decontamination": op9_decontamination}
_LOWER = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"REGEXP_EXTRACT_ALL({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, ARRAY_TO_STRING(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item_id, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS i FROM (SELECT *, LEAST(10, LEN(w)) AS n FROM b WHERE LEN(w) > 0))),
doc AS (SELECT doc_id, i, n, ARRAY_TO_STRING(w[i:i + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM item) ON LEN(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM doc JOIN item USING (n, win)),
place AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(i, i + n)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, COUNT(*) AS n_items, SHA256(STRING_AGG(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  COALESCE(h, SHA256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN names USING (doc_id)
""",
}
