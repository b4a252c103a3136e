"""Shared plumbing of the corpus operators: tables, scratch space, distributed numbering, Arrow text."""

from __future__ import annotations

import gc
import uuid
from functools import reduce, wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import partitions_for, scratch, ship  # noqa: F401 - of this module for the operators

ARROW_BYTES = 4 << 20
ARROW_ROWS = 4096
#: Bytes of text that a step with much memory for each byte takes at once.
PIECE_BYTES = 1 << 20
HOT_KEYS = 1000
#: Most bits of a bit table: bounds what is collected and broadcast (16 MB).
TABLE_BITS = 1 << 27
#: Spark's setting by which an execution's shuffle files go when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's settings: up to how many bytes a table is broadcast, as estimated before anything runs and as measured by AQE.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes up to which an estimate is trusted: Spark counts an exploded list, or a row that Python makes many of, as one.
TRUSTED = 256 << 10
_PATHS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, fmt: str = "parquet", **options) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives lost executors, is compressed.

    The shuffle files of the writing go with it; else they'd stay until the driver happens to collect its garbage. Tables
    are broadcast up to the session's size if it is measured, up to TRUSTED if it is but estimated.
    """
    path, conf = f"{scratch(df.sparkSession)}/tables/{uuid.uuid4().hex}", df.sparkSession.conf
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    ours = {FILES_GO: "true", ESTIMATED: str(min(most, TRUSTED)), MEASURED: conf.get(MEASURED, None) or str(most)}
    own = {k: conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            conf.set(k, v)
        df.write.options(**options).format(fmt).save(path)
    finally:
        for k, v in own.items():
            conf.unset(k) if v is None else conf.set(k, v)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def _delete(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(operator):
    """The operator, which deletes all that it has stored on its way and its results (frames or others) don't read."""

    @wraps(operator)
    def run(*args, **options):
        before = set(_PATHS)
        found = operator(*args, **options)
        frames = [x for x in (found if isinstance(found, tuple) else (found,)) if isinstance(x, DataFrame)]
        read = {f.rpartition("/")[0].rpartition("/")[2] for x in frames for f in x.inputFiles()}
        for path in [p for p in _PATHS if p not in before and p.rpartition("/")[2] not in read]:
            _PATHS.remove(path)
            _delete(next(x.sparkSession for x in (*frames, *args) if isinstance(x, DataFrame)), path)
        return found

    return run


def swept(spark: SparkSession) -> None:
    """Collects the driver's garbage: plans, broadcasts and task records of what has run, for operators of very many small jobs.

    Its JVM else lets the heap grow to the limit first; by a collection in full it gives back what is free.
    """
    gc.collect()  # Python's frames hold plans
    give_back()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Deletes all that ``stored`` has written for this process; results that still read it are lost. Returns how many."""
    n = 0
    while _PATHS:
        n += _delete(spark, _PATHS.pop())
    return n


def ready_workers(spark: SparkSession) -> None:
    """Sends this package to the executors, and bounds what an Arrow batch holds in rows and bytes.

    The two bounds are settings of the session, always the same; smaller ones of the caller stay. They hold for later plans
    too, as plans are lazy: results don't depend on them, memory does.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    ship(spark)


def pieces(batches, column: str = "text", most: int = PIECE_BYTES):
    """The batches' rows in the same order, cut so that a piece has at most so many bytes of the column, or one row."""
    for b in batches:
        at, off = 0, utf8(b.column(column).fill_null(""))[1] if b.num_rows else np.zeros(1, np.int64)
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def give_back() -> None:
    """What this process holds free goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def trimmed(batches):
    """The batches of a worker; what it holds free goes back to the system every 16 batches and at the end, as idle workers stay alive."""
    for i, b in enumerate(batches, 1):
        yield b
        del b
        if i % 16 == 0:
            give_back()
    give_back()


def bucket_rows(rows: int) -> int:
    """How many rows a bucket is meant to hold: some hundreds, or the root of all rows if more, so that the table of buckets is small."""
    return max(300, round(rows**0.5))


def bucket_count(rows: int, of: int | None = None) -> int:
    """Buckets for ``of`` of all rows (default: all)."""
    return int(max(1, -(-(rows if of is None else of) // bucket_rows(rows))))


def numbered(df: DataFrame, keys: list[str], order: list[str], buckets: int | Column, out: str) -> DataFrame:
    """Adds a gapless number from 0 within keys, without gathering a key's rows in one task.

    Rows are ordered by a hash of ``order``, then by ``order``. Each (key, bucket of the hash) is numbered alone; the counts
    of earlier buckets, one row a bucket, are added. Rows that are NULL in the first of ``order`` are told apart by where
    they are read, so that many of them, alike in all else, don't meet in one bucket. buckets: a number, or a column that
    gives it by key.
    """
    b, tie = f"_{out}_b", f"_{out}_t"
    place = F.when(F.col(order[0]).isNull(), F.monotonically_increasing_id())
    d = df.withColumn(tie, F.xxhash64(*order, place))
    part = F.shiftrightunsigned(tie, 40).cast("long") * buckets / (1 << 24)  # of the top bits: by hash is by bucket first
    d = d.withColumn(b, F.floor(part).cast("int"))
    by = [*keys, b]
    own = Window.partitionBy(*by).orderBy(tie, *order)
    before = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    left, right = d.withColumn("_own", F.row_number().over(own) - 1).alias("l"), before.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    kept = [F.col(f"l.`{c}`") for c in df.columns]
    return left.join(right, reduce(lambda x, y: x & y, same), "left").select(*kept, (F.col("_before") + F.col("_own")).cast("long").alias(out))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to keyed, which has a row for each key (or few) and in ``count`` how many rows have the key.

    Keys of a HOT_KEYS-th of all rows or more, which are HOT_KEYS at most, are broadcast; the others are shuffled. So no key's
    rows meet in one task.
    """
    hot = F.col(count) * HOT_KEYS >= total
    heavy = keyed.where(hot)
    rest = rows.join(F.broadcast(heavy.select(key).distinct()), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(keyed.where(~hot), key))


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls, without copying the text."""
    import pyarrow as pa

    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class BitTable:
    """2**bits bits; a hash's top bits say which one is its own."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray) -> None:
        self.bits, self.table = bits, np.zeros(1 << (bits - 6), "<u8")
        self.table[words] = values.view("<u8")

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(df: DataFrame, column: str) -> BitTable:
    """The table of a column of hashes (long): one row for every 64 bits, or'ed together on the executors."""
    n = df.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(TABLE_BITS.bit_length() - 1, max(16, (64 * n).bit_length()))
    slot = F.shiftrightunsigned(column, 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    rows = df.groupBy(F.shiftrightunsigned(column, 70 - bits).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    return BitTable(bits, np.asarray(rows["word"], np.int64), np.asarray(rows["bits"], np.int64))
