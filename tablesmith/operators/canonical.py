"""Canonical category values: aliases, spellings by case and white space, fuzzy suggestions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ISO
from ..functions.similarity import ratio, sorted_tokens
from ..functions.text import folded
from .dedup import near_duplicates
from .ledger import ROW_ID, Change, Ledger, recorded

#: Folded spelling to label.
ALIASES = {
    "america": "United States",
    "u.s.": "United States",
    "u.s.a": "United States",
    "u.s.a.": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "us": "United States",
    "usa": "United States",
    "britain": "United Kingdom",
    "england": "United Kingdom",
    "great britain": "United Kingdom",
    "u.k.": "United Kingdom",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "active": "active",
    "inactive": "inactive",
}
FUZZY_AT, FUZZY_MOST = 85.0, 500
#: Merged spellings of a column that become a map in the plan; those of more are joined.
MAPPED = 2000


def eligible(df: DataFrame) -> list[str]:
    """Text columns with a value of which no more than half look like ISO dates."""
    texts = [c for c, t in df.dtypes if t == "string" and c != ROW_ID]
    if not texts:
        return []
    row = df.agg(*[F.struct(F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`").rlike(ISO)).alias("iso")).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]["n"] and row[c]["iso"] <= 0.5 * row[c]["n"]]


def spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, folded, value, n): how often each spelling occurs, for all columns in one aggregate."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("x")
    rows = df.select(cells).select("x.*").where("value is not null")
    return rows.groupBy("column", folded(F.col("value")).alias("folded"), "value").agg(F.count(F.lit(1)).alias("n"))


def representatives(spelled: DataFrame) -> DataFrame:
    """(column, folded, label): the commonest spelling, the greatest of equally common ones; only where there are several."""
    out = spelled.groupBy("column", "folded").agg(F.max_by("value", F.struct("n", "value")).alias("label"), F.count(F.lit(1)).alias("_k"))
    return out.where("_k > 1").drop("_k")


def case_merged(df: DataFrame, column: str) -> DataFrame:
    """The column's spellings that differ in case or outer white space, made one; aliases are left alone."""
    chosen = representatives(spellings(df, [column])).select(F.col("folded").alias("_f"), F.col("label").alias("_l"))
    out = df.join(chosen, folded(F.col(f"`{column}`")) == F.col("_f"), "left")
    return out.select(*[F.coalesce("_l", f"`{c}`").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def aliased(column: str, aliases: Mapping[str, str] | None = None):
    """The label of a value in the alias table, else the value."""
    c, aliases = F.col(f"`{column}`"), ALIASES if aliases is None else aliases
    pairs = [x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), folded(c)), c) if pairs else c


def canonicalize(df: DataFrame, table: str = "table", columns: list[str] | None = None) -> tuple[DataFrame, Ledger]:
    """Alias and case merges on all eligible columns, with their ledger records.

    One aggregate counts the spellings of all columns. Columns of at most MAPPED merged spellings get theirs as a map within
    the projection; only those of more are joined.
    """
    columns = eligible(df) if columns is None else columns
    if not columns:
        return df, Ledger()
    out = df.select(*[aliased(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    chosen = representatives(spellings(out, columns))
    several = {r["column"]: r["n"] for r in chosen.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c, n in several.items() if n <= MAPPED]
    maps: dict[str, dict[str, str]] = {c: {} for c in small}
    if small:
        for r in chosen.where(F.col("column").isin(small)).collect():  # MAPPED a column at most
            maps[r["column"]][r["folded"]] = r["label"]
    was = lambda c: f"was:{c}"
    step = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").alias(was(c)) for c in columns])
    step = step.select(*[aliased(c).alias(c) if c in columns else F.col(f"`{c}`") for c in step.columns], *[aliased(c).alias(f"alias:{c}") for c in columns])
    step = step.select(*[aliased(c, maps[c]).alias(c) if c in small else F.col(f"`{c}`") for c in step.columns])
    for c in several.keys() - maps.keys():
        mine = chosen.where(F.col("column") == c).select(F.col("folded").alias("_f"), F.col("label").alias("_l"))
        step = step.join(mine, folded(F.col(f"`{c}`")) == F.col("_f"), "left").withColumn(c, F.coalesce("_l", f"`{c}`")).drop("_f", "_l")
    of = lambda p, c: F.col(f"`{p}{c}`")
    changes = [Change(c, "canonicalize_alias", of("alias:", c) != of("was:", c), of("was:", c), of("alias:", c)) for c in columns]
    changes += [Change(c, "canonicalize_case", of("", c) != of("alias:", c), of("alias:", c), of("", c)) for c in columns if c in several]
    return step.select(*[F.col(f"`{c}`") for c in df.columns]), recorded(step, table, changes)


def fuzzy_pairs(df: DataFrame, column: str) -> DataFrame:
    """(a, b, similarity): all pairs of the column's spellings that are alike by FUZZY_AT, with no cap; nothing is collected.

    Spellings are first told apart by case and outer white space, then found as near duplicates are, by rare letter pairs.
    """
    values = df.select(F.trim(F.col(f"`{column}`")).alias("value")).where("value is not null").groupBy(folded(F.col("value")).alias("f")).agg(F.max("value").alias("value"))
    rows = values.select(F.xxhash64("value").alias(ROW_ID), "value")
    near = near_duplicates(rows, FUZZY_AT)
    of = lambda n: rows.select(F.col(ROW_ID).alias(f"row_{n}"), F.col("value").alias(n))
    return near.join(of("a"), "row_a").join(of("b"), "row_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def suggestions(df: DataFrame, column: str, most: int = FUZZY_MOST) -> list[dict]:
    """Merges a person may want: by alias and case (high confidence), and fuzzy ones (medium), which are never applied.

    A list for a person to read, so all of it is bounded: up to ``most`` of each kind, and fuzzy groups among the ``most``
    commonest values; a value joins the first group whose first value is alike. ``fuzzy_pairs`` has all pairs of all values.
    """
    spelled = spellings(df, [column])
    several = spelled.groupBy("folded").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max_by("value", F.struct("n", "value")).alias("label"))
    known = several.where(F.col("folded").isin(*ALIASES)).collect()  # as many as there are aliases
    merged = several.where("k > 1").orderBy(F.desc("n"), "folded").limit(most).collect()
    names = {r["folded"] for r in (*known, *merged)}
    values: dict[str, list[str]] = {}
    ranked = spelled.where(F.col("folded").isin(*names)).withColumn("_p", F.row_number().over(Window.partitionBy("folded").orderBy(F.desc("n"), "value"))) if names else None
    for r in ranked.where(F.col("_p") <= most).collect() if names else ():
        values.setdefault(r["folded"], []).append(r["value"])
    out = [{"column": column, "kind": "alias", "confidence": "high", "values": sorted(values[r["folded"]]), "label": ALIASES[r["folded"]]} for r in known]
    out += [{"column": column, "kind": "case", "confidence": "high", "values": sorted(values[r["folded"]]), "label": r["label"]} for r in merged]
    top = spelled.withColumn("_s", sorted_tokens(F.col("value"))).orderBy(F.desc("n"), "value").limit(most).collect()
    groups: list[list] = []
    for r in top:
        home = next((g for g in groups if ratio(g[0]["_s"], r["_s"]) >= FUZZY_AT), None)
        if home is None:
            groups.append([r])
        else:
            home.append(r)
    for g in groups:
        if len({r["folded"] for r in g}) > 1:
            out.append({"column": column, "kind": "fuzzy", "confidence": "medium", "values": [r["value"] for r in g], "label": max(g, key=lambda r: (r["n"], r["value"]))["value"]})
    return sorted(out, key=lambda s: (s["kind"], s["label"]))
