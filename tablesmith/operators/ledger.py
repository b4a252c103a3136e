"""What cleaning has changed: one record for each table, column and rule, with samples."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "_row_id"
SAMPLES, HEAD = 5, 1000


@dataclass
class ChangeRecord:
    table: str
    column: str
    rule: str
    cells_affected: int
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    reversible: bool = True


@dataclass
class Ledger:
    records: list[ChangeRecord] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(r.cells_affected for r in self.records)

    def rules(self) -> set[str]:
        return {r.rule for r in self.records}

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = "table string, column string, rule string, cells_affected long, before array<string>, after array<string>, reversible boolean"
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self.records], schema)


@dataclass
class Change:
    """One rule on one column, as expressions over the same rows."""

    column: str
    rule: str
    changed: Column
    before: Column
    after: Column


def recorded(df: DataFrame, table: str, changes: list[Change], samples: int = SAMPLES, counts: dict[str, int] | None = None) -> Ledger:
    """The records of all changes. One aggregate counts them; samples are those of least row id.

    The first HEAD rows have samples of most changes; those that are rare there are looked for, with the others left out.
    counts: what ``counted`` has counted, if a plan has it already.
    """
    if not changes:
        return Ledger()
    if counts is None:
        counts = df.agg(*counted(changes)).first().asDict()
    wanted = [i for i in range(len(changes)) if counts[f"change:{i}"]]
    if not wanted:
        return Ledger()
    row = F.col(f"`{ROW_ID}`") if ROW_ID in df.columns else F.monotonically_increasing_id()
    head = (df.where(F.col(f"`{ROW_ID}`") < HEAD) if ROW_ID in df.columns else df.limit(HEAD)).select(row.alias("_r"), *_cells(changes, wanted)).orderBy("_r").limit(HEAD).collect()
    taken = {i: [(r[f"c{i}"]["before"], r[f"c{i}"]["after"]) for r in head if r[f"c{i}"] is not None][:samples] for i in wanted}
    rare = [i for i in wanted if len(taken[i]) < min(samples, counts[f"change:{i}"])]
    if rare:
        found = [df.select(row.alias("_r"), *_cells(changes, [i])).where(F.col(f"c{i}").isNotNull()).orderBy("_r").limit(samples).select(F.lit(i).alias("i"), "_r", F.col(f"c{i}").alias("c")) for i in rare]
        taken |= {i: [] for i in rare}
        for r in sorted(reduce(DataFrame.unionByName, found).collect(), key=lambda r: r["_r"]):
            taken[r["i"]].append((r["c"]["before"], r["c"]["after"]))
    return Ledger([ChangeRecord(table, changes[i].column, changes[i].rule, counts[f"change:{i}"], [b for b, _ in taken[i]], [a for _, a in taken[i]]) for i in wanted])


def counted(changes: list[Change]) -> list[Column]:
    """Aggregates that count each change."""
    return [F.count_if(c.changed).alias(f"change:{i}") for i, c in enumerate(changes)]


def _cells(changes: list[Change], which: list[int]) -> list[Column]:
    return [F.when(changes[i].changed, F.struct(changes[i].before.cast("string").alias("before"), changes[i].after.cast("string").alias("after"))).alias(f"c{i}") for i in which]
