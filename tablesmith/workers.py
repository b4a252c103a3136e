"""What Spark jobs of this package need of the session: the package on the executors, and numbers of partitions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files that a partition is meant to hold at most.
PARTITION_BYTES = 64 << 20
#: Bytes of input files under which a table counts as small.
SMALL_BYTES = 256 << 20
_OWN: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_tablesmith_sent", None) is None:
        root = Path(__file__).resolve().parent
        sc._tablesmith_sent = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        sc.addPyFile(sc._tablesmith_sent)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that df reads; what has no known size counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def partitions_for(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more if the files that df reads would make partitions too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PARTITION_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if the files it reads are so few that most cores would have none; else as it is.

    For plans that take long over each row. What is dealt out is less than SMALL_BYTES, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and 0 < input_bytes(df) < SMALL_BYTES else df


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; if unset, in local mode one of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/tablesmith-{os.getpid()}"
        if not _OWN:
            atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
        _OWN.add(where)
    return where.rstrip("/")
