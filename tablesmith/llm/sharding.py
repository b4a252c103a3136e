"""Operator 7: shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups of equal texts.

What the driver holds is bounded: not groups but size classes. Sizes up to 2**EXACT_BITS are their own class; a larger
size belongs to the class of the next multiple of a 2**-EXACT_BITS part of its power of two, so that there are fewer than
2**EXACT_BITS * 32 classes whatever the input, and a bin is never filled beyond its capacity. Items of one class are
interchangeable, so the packing of classes is the packing of items.

A group that alone is larger than a shard's even share can't be kept whole under equal bytes; it is cut into pieces of as
many copies as fit the share (there are at most as many such groups as shards). All other groups stay whole.

Nulls: a null text counts as an empty one (size is the overhead alone); null ids keep their rows. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, hot_join, numbered, stored, table, tidy

EXACT_BITS = 16
LEAF = 512


class CapacityTree:
    """Open bins ordered by (remaining capacity, bin): a two-level B-tree whose leaves split when full."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.firsts: list[tuple[int, int]] = [(-1, -1)]

    def add(self, left: int, bin_: int) -> None:
        at = max(0, bisect_left(self.firsts, (left, bin_)) - 1)
        leaf = self.leaves[at]
        insort(leaf, (left, bin_))
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.firsts[at : at + 1] = [self.firsts[at], leaf[half]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that still holds ``size``."""
        key = (size, -1)
        at = max(0, bisect_left(self.firsts, key) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, key)
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and len(self.leaves) > 1:
                    del self.leaves[at], self.firsts[at]
                    self.firsts[0] = (-1, -1)
                return found
            at += 1
        return None


def pack(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing. classes: (size, items). Returns runs (size, bin, items), or None if over ``most`` bins."""
    tree, runs, opened = CapacityTree(), [], 0
    for size, items in sorted(classes, reverse=True):
        while items:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and opened >= most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            left, bin_ = found
            put = min(items, left // size) if size else items
            runs.append((size, bin_, put))
            items -= put
            tree.add(left - put * size, bin_)
    return runs


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """The packing of least capacity, to within a 1/4096 of the even share, that needs no more than ``shards`` bins."""
    total = sum(s * n for s, n in classes)
    low = max(-(-total // shards), max((s for s, _ in classes), default=0))
    step = max(1, low // 4096)
    found, jump = pack(classes, low, shards), step
    high = low
    while found is None:
        low, high = high, high + jump
        jump *= 2
        found = pack(classes, high, shards)
    while high - low > step:
        mid = (low + high) // 2
        tried = pack(classes, mid, shards)
        low, high, found = (low, mid, tried) if tried is not None else (mid, high, found)
    return found


def size_class(size):
    """The class of a size, as a column: itself if small, else rounded up to EXACT_BITS significant bits."""
    bits = F.greatest(F.length(F.bin(size)) - EXACT_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), bits).cast("long")
    return (F.floor((size + unit - 1) / unit) * unit).cast("long")


@tidy
def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text): see the module's docstring."""
    text = F.coalesce("text", F.lit(""))
    base = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(text, "UTF-8")).alias("key"),
        )
    )
    total, rows = base.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = max(1, total // shards)
    buckets = bucket_count(rows)
    groups = base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    fits = F.greatest(F.lit(1), F.least("n", F.floor(F.lit(share) / F.col("size")))).cast("long")
    groups = groups.withColumn("fits", fits)
    items = stored(
        groups.select("key", "n", "size", "fits", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("fits")).cast("int") - 1)).alias("piece"))
        .withColumn("copies", F.least("fits", F.col("n") - F.col("piece") * F.col("fits")))
        .select("key", "n", "fits", "piece", "copies", size_class(F.col("copies") * F.col("size")).alias("class"))
    )
    classes = [(r["class"], r["n"]) for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = pack_into(classes, shards)
    spark, placed, upto = docs.sparkSession, {}, {}
    for c, b, n in runs:
        upto[c] = upto.get(c, 0) + n
        placed.setdefault(c, []).append((upto[c], b))
    # Bounded: a row for each size class, each with at most a run for each shard.
    where = spark.createDataFrame([(c, x) for c, x in placed.items()], "class long, runs array<struct<upto:long,shard:int>>")
    ranked = numbered(items, ["class"], ["key", "piece"], buckets, "rank")
    shard = F.filter("runs", lambda r: r["upto"] > F.col("rank"))[0]["shard"].alias("shard")
    ranked = stored(ranked.join(where, "class").select(F.struct("key", "piece").alias("at"), "copies", shard))
    # Groups over a shard's even share: no more than there are shards.
    large = items.where((F.col("piece") == 0) & (F.col("n") > F.col("fits"))).select("key", "fits")
    split = base.join(F.broadcast(large), "key")
    split = numbered(split, ["key"], ["doc_id", "text_crc32"], buckets, "copy").withColumn("piece", F.floor(F.col("copy") / F.col("fits")).cast("int"))
    whole = base.join(F.broadcast(large), "key", "left_anti").withColumn("piece", F.lit(0))
    cols = ["doc_id", "size", "text_crc32", "key", "piece"]
    pieces = whole.select(cols).unionByName(split.select(cols)).withColumn("at", F.struct("key", "piece")).drop("key", "piece")
    out = hot_join(pieces, ranked, "at", "copies", rows).select("doc_id", "size", "text_crc32", "shard")
    return numbered(stored(out), ["shard"], ["doc_id", "text_crc32", "size"], bucket_count(rows, rows // shards + 1), "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"), 40, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
