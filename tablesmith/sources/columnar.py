"""Columnar tables, read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc")


def scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A parquet or ORC table; filters and columns reach the files."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    return spark.read.format(fmt).load(path)


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: scan(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names}
