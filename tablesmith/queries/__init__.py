"""Registered queries: each with the SQL that DuckDB runs on the same tables, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


class Tables(Mapping):
    """The tables of a folder by name, read when asked for."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)


def same(sql: str) -> Query:
    """A query whose text both engines run; tables stand in braces."""
    return spelled(sql, sql)


def spelled(spark_sql: str, oracle: str) -> Query:
    """A query in each engine's own spelling; tables stand in braces."""
    used = [t for t in Tables.NAMES if f"{{{t}}}" in spark_sql]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = Tables(spark, folder)
        return spark.sql(spark_sql, **{t: tables[t] for t in used})

    for t in Tables.NAMES:
        oracle = oracle.replace(f"{{{t}}}", t)
    return Query(run, oracle)


def planned(build: Callable[[Mapping[str, DataFrame], SparkSession], DataFrame], oracle: str | None = None) -> Query:
    """A query built with DataFrames from the tables."""
    return Query(lambda spark, folder: build(Tables(spark, folder), spark), oracle)


def every() -> dict[str, Query]:
    from . import cleaning, linking, profiling, relational, windows

    return {k: q for m in (relational, windows, cleaning, profiling, linking) for k, q in m.QUERIES.items()}
