"""As-of join: for each left row the last right row of its key at or before its time."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import SMALL_BYTES, input_bytes

RANGES = 32


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, take: list[str], ranges: int | None = None) -> DataFrame:
    """left with the columns ``take`` of the matching right row, NULL if none. Rows without a time match nothing. One union, one shuffle, one running window.

    ranges: time is cut into so many, and each (key, range) is a task's own, so that a key of very many rows is no single
    task; what a range inherits is the last right row of the key's earlier ranges, a row for each key and range. By default
    1, or RANGES if more than SMALL_BYTES are read.
    """
    if ranges is None:
        ranges = RANGES if input_bytes(left) + input_bytes(right) > SMALL_BYTES else 1
    a = left.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_r"))
    b = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*take).alias("_r"))
    rows = a.unionByName(b)
    if ranges > 1:
        moment = F.col("_t") if rows.schema["_t"].dataType.typeName() not in ("date", "timestamp_ntz") else F.col("_t").cast("timestamp")
        rows = rows.withColumn("_x", F.coalesce(moment.cast("double"), F.lit(float("nan"))))
        cuts = sorted(set(rows.approxQuantile("_x", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) or [0.0]
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_x", outputCol="_range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_range", F.lit(0.0))
    w = Window.partitionBy(*on, "_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if ranges > 1:
        last = rows.where("_side = 0").groupBy(*on, "_range").agg(F.max_by("_r", "_t").alias("_last"))
        spans = rows.select(*on, "_range").distinct().join(last.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(on)}).withColumnRenamed("_range", "_rr"), [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)] + [F.col("_range") == F.col("_rr")], "left")
        before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.col("_range").alias("_rr"), F.last("_last", ignorenulls=True).over(before).alias("_c"))
        out = out.join(carried, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)] + [F.col("_range") == F.col("_rr")], "left").withColumn("_m", F.coalesce("_m", F.when(F.col("_t").isNotNull(), F.col("_c"))))
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in take])
