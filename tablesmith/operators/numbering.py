"""Gapless row numbers over an order, from counts of ranges."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import partitions_for


def gapless(df: DataFrame, by: str, out: str | None = None) -> DataFrame:
    """df with rows numbered from 0 in the order of ``by`` (NULLs last), in the column ``out``, else in place of ``by``.

    Ranges are cut by approximate quantiles and numbered side by side; what comes before a range is a sum over ranges. Rows
    travel as one struct, so that columns of any name are safe; a column named ``out`` is replaced.
    """
    out = out or by
    parts = partitions_for(df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{by}`").alias("at"), F.coalesce(F.col(f"`{by}`").cast("double"), F.lit(float("nan"))).alias("x"))
    cuts = sorted(set(rows.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts))) or [0.0]
    cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="bucket", handleInvalid="keep")
    rows = cutter.transform(rows)
    before = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = before.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(F.asc_nulls_last("at"))) - 1
    number = (F.col("before") + F.col("own")).cast("long").alias(out)
    numbered = rows.withColumn("own", own).join(F.broadcast(before), "bucket")
    kept = [number if c == out else F.col(f"row.`{c}`") for c in df.columns]
    return numbered.select(*kept, *([] if out in df.columns else [number]))
