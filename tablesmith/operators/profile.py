"""Column profiles: one wide aggregate for a table, one row for a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import data_columns
from .ledger import ROW_ID

#: What a text column may be made of.
FINGERPRINTS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "url": r"(?i)^https?://",
    "iso_date": r"^\d{4}-\d{2}-\d{2}$",
}
#: Names of ids, shares and limits of roles.
ID_NAME = r"(?i)(^|_)(id|key|code|no|num)$"
SHARE, DIMENSION_RATIO, DIMENSION_MOST = 0.9, 0.7, 50
HEAD = 1000
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def logical(dtype: str) -> str:
    if dtype == "boolean":
        return "boolean"
    if dtype in NUMBERS or dtype.startswith("decimal"):
        return "numeric"
    return "date" if dtype in ("date", "timestamp", "timestamp_ntz") else "text"


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as C and SQL engines do: what x times a power of ten is, half away from zero.

    ``F.round`` rounds the digits that a double is printed with, so 9 / 60000 = 0.00015, which is a bit less, would be 0.0002.
    """
    return F.round(x * 10.0**digits) / 10.0**digits


def _measures(c: str, dtype: str, approximate: bool) -> dict[str, Column]:
    x, kind = F.col(f"`{c}`"), logical(dtype)
    text = x.cast("string")
    out = {"n": F.count(F.lit(1)), "filled": F.count(x), "distinct_count": F.approx_count_distinct(x, 0.01) if approximate else F.lit(None).cast("long")}
    none = F.lit(None).cast("double")
    out["numeric_min"] = F.min(x).cast("double") if kind == "numeric" else none
    out["numeric_max"] = F.max(x).cast("double") if kind == "numeric" else none
    out["whole"] = F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)) if kind == "numeric" else F.lit(False)
    out["text_min"] = F.min(text) if kind in ("text", "date") else F.lit(None).cast("string")
    out["text_max"] = F.max(text) if kind in ("text", "date") else F.lit(None).cast("string")
    out["avg_len"] = rounded(F.avg(F.length(text)), 2) if kind == "text" else none
    for name, pattern in FINGERPRINTS.items():
        out[name] = F.count_if(text.rlike(pattern)) if kind == "text" else F.lit(0).cast("long")
    return out


def profile(df: DataFrame, table: str = "table", approximate: bool = False) -> DataFrame:
    """A row for each column: nulls, distinct values, logical type, fingerprint, role, range, length.

    approximate: distinct counts by sketches of 1 % error, for tables too large to deal all values by column; then no column
    counts as unique unless its estimate says so exactly.
    """
    types = dict(df.dtypes)
    cols = [c for c in data_columns(df) if not types[c].startswith(("array", "map", "struct"))]
    one = df.agg(*[F.struct(*[v.alias(k) for k, v in _measures(c, types[c], approximate).items()]).alias(f"_{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(logical(types[c])).alias("dtype"), F.col(f"_{i}").alias("m")) for i, c in enumerate(cols)])).alias("x")
    p = one.select(rows).select("x.position", "x.column", "x.dtype", "x.m.*")
    if not approximate:
        p = p.drop("distinct_count").join(F.broadcast(distinct_counts(df, cols)), "position")  # a row for each column
    share = lambda name: (F.col("filled") > 0) & (F.col(name) >= SHARE * F.col("filled"))
    p = p.withColumn("dtype", F.when((F.col("dtype") == "text") & share("iso_date"), "date").otherwise(F.col("dtype")))
    found = F.when(F.col("whole"), "integer")
    for name in reversed(FINGERPRINTS):
        found = F.when(share(name), name).otherwise(found)
    ratio = F.when(F.col("filled") > 0, F.col("distinct_count") / F.col("filled")).otherwise(0.0)
    named = F.col("column").rlike(ID_NAME)
    full = (F.col("filled") == F.col("n")) & (F.col("distinct_count") == F.col("filled"))
    p = p.select(
        F.lit(table).alias("table"),
        "position",
        "column",
        "dtype",
        "n",
        "filled",
        rounded(F.when(F.col("n") > 0, 1 - F.col("filled") / F.col("n")).otherwise(1.0), 4).alias("null_pct"),
        "distinct_count",
        rounded(ratio, 4).alias("cardinality_ratio"),
        found.alias("fingerprint"),
        (full & (F.col("distinct_count") > 1) & (named | F.coalesce(found == "uuid", F.lit(False)))).alias("is_id"),
        (full & (F.col("filled") > 0)).alias("is_unique"),
        "whole",
        "numeric_min",
        "numeric_max",
        F.when(F.col("dtype") == "date", F.col("text_min")).alias("date_min"),
        F.when(F.col("dtype") == "date", F.col("text_max")).alias("date_max"),
        F.when(F.col("dtype") == "text", F.col("avg_len")).alias("avg_len"),
        named.alias("id_named"),
        ratio.alias("_ratio"),
    )
    role = (
        F.when(F.col("dtype") == "date", "timestamp")
        .when(F.col("is_id") | (F.col("id_named") & (F.col("dtype") != "text")), "id")
        .when(F.col("dtype") == "numeric", "measure")
        .when(F.col("dtype") == "boolean", "dimension")
        .when((F.col("_ratio") <= DIMENSION_RATIO) & (F.col("distinct_count") <= DIMENSION_MOST), "dimension")
        .otherwise("text")
    )
    return p.withColumn("role", role).drop("_ratio", "id_named")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(position, distinct_count) of each column by its values: a narrow scan and a pre-aggregated shuffle for each, all in one job."""
    counts = [df.agg(F.lit(i).alias("position"), F.count_distinct(F.col(f"`{c}`")).alias("distinct_count")) for i, c in enumerate(cols)]
    return reduce(DataFrame.unionByName, counts)


def samples(df: DataFrame, columns: list[str], most: int = 5) -> dict[str, list]:
    """The first distinct values of each column in row order (any order if rows have no ids).

    The first HEAD rows tell for most columns; the others, of fewer values or many nulls there, are searched whole in one job.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in columns if c in kinds and not kinds[c].startswith(("array", "map", "struct"))]
    if not columns:
        return {}
    ordered = ROW_ID in df.columns
    cells = [F.col(f"`{c}`") for c in columns]
    head = (df.orderBy(ROW_ID) if ordered else df).select(*cells).limit(HEAD).collect()
    out = {c: list(dict.fromkeys(r[i] for r in head if r[i] is not None))[:most] for i, c in enumerate(columns)}
    short = [c for c in columns if len(out[c]) < most] if len(head) == HEAD else []
    if short:
        row = F.col(ROW_ID) if ordered else F.lit(0)
        firsts = [df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.min(row).alias("r")).orderBy("r", "v").limit(most) for c in short]
        wide = [f.select(F.lit(i).alias("i"), "r", *[(F.col("v") if c == own else F.lit(None).cast(kinds[c])).alias(f"c{j}") for j, c in enumerate(short)]) for i, (f, own) in enumerate(zip(firsts, short, strict=True))]
        found: dict[str, list] = {c: [] for c in short}
        for r in sorted(reduce(DataFrame.unionByName, wide).collect(), key=lambda r: (r["r"], str(r[f"c{r['i']}"]))):
            found[short[r["i"]]].append(r[f"c{r['i']}"])
        out |= found
    return out
