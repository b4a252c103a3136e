"""Windowed aggregates over event time. The same functions plan batch tables and streams; a watermark only tells on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import scratch


def _windowed(df: DataFrame, time: str, window, keys: list[str], aggs: list[Column], delay: str | None, names: tuple[str, str]) -> DataFrame:
    """The aggregates by window and key. Watermarks need instants: local times are read as instants and given back as local."""
    local = dict(df.dtypes)[time] == "timestamp_ntz"
    if delay and df.isStreaming:
        df = (df.withColumn(time, F.col(time).cast("timestamp")) if local else df).withWatermark(time, delay)
    out = df.groupBy(window.alias("_w"), *keys).agg(*aggs)
    ends = [F.col(f"_w.{e}").cast("timestamp_ntz" if local else "timestamp").alias(n) for e, n in zip(("start", "end"), names, strict=True)]
    return out.select(*ends, *[F.col(f"`{c}`") for c in out.columns if c != "_w"])


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """One row for each window of a size, key by key."""
    return _windowed(df, time, F.window(time, size), keys, aggs, delay, ("window_start", "window_end"))


def sliding(df: DataFrame, time: str, size: str, step: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """Windows of a size that begin at every step."""
    return _windowed(df, time, F.window(time, size, step), keys, aggs, delay, ("window_start", "window_end"))


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """Runs of events without a gap, key by key."""
    return _windowed(df, time, F.session_window(time, gap), keys, aggs, delay, ("session_start", "session_end"))


def files(spark, folder: str, schema, fmt: str = "parquet", files_per_trigger: int = 64, only: str | None = None) -> DataFrame:
    """A folder that files arrive in, as a stream. only: a pattern of the names that are read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt)
    return (reader.option("pathGlobFilter", only) if only else reader).load(folder)


def drained(stream: DataFrame) -> DataFrame:
    """What an aggregated stream has come to once all that has arrived is read. Its state and results are in the shared folder."""
    spark = stream.sparkSession
    place = f"{scratch(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/result")
