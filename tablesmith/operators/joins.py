"""Join discovery by value containment: which column of which table refers to which unique column of another."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from .profile import logical, profile

#: Weights of a score, labels and limits.
W_CONTAINED, W_CARDINALITY, W_TYPE, W_NAME, REPEATS_BONUS = 0.60, 0.25, 0.10, 0.05, 0.02
KEPT_AT, MEDIUM_AT, HIGH_AT = 0.55, 0.65, 0.80
PENALTY, NAME_STRONG, NAME_WEAK = 0.50, 0.7, 0.5
FEW, DENSE = 50, 0.9
WORD_BITS = 62
SUFFIX = re.compile(r"_?(id|key|code|no|num|fk|pk|ref)$")
ID_NAME = re.compile(r"(^|_)(id|key|code|no|num)$")


@dataclass
class Edge:
    """A foreign column that refers to a unique one."""

    fk_table: str
    fk_column: str
    pk_table: str
    pk_column: str
    confidence: float
    label: str
    containment: float = 0.0
    name_similarity: float = 0.0
    active: bool = False
    manual: bool = False

    @property
    def key(self) -> tuple[str, str, str, str]:
        return self.fk_table, self.fk_column, self.pk_table, self.pk_column


def columns_of(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, logical type) of all columns whose values can be compared."""
    return [(t, c, logical(kind)) for t, df in tables.items() for c, kind in df.dtypes if not c.startswith("_") and not kind.startswith(("array", "map", "struct", "binary"))]


def valued(c: str, kind: str) -> Column:
    """A column's values as they are compared: numbers as doubles, whatever their type, all else as text."""
    return F.col(f"`{c}`").cast("double" if kind == "numeric" else "string")


def hashed(x: Column, kind: str, printed: bool = False) -> Column:
    """64-bit hashes of values as they are compared. printed: -0.0, which equals 0.0 as a number but not as text, has one of its own."""
    minus = (x == 0) & (x.cast("string") == "-0.0")
    return F.when(minus, F.xxhash64(F.lit("-0.0"))).otherwise(F.xxhash64(x)) if printed and kind == "numeric" else F.xxhash64(x)


def compared(df: DataFrame, printed: bool = False) -> DataFrame:
    """The columns whose values can be compared, as they are compared; numbers as their hashes if they are compared as printed."""
    columns = [(c, kind, valued(c, kind)) for _, c, kind in columns_of({"": df})]
    return df.select(*[(F.when(x.isNotNull(), hashed(x, kind, printed)) if printed and kind == "numeric" else x).alias(c) for c, kind, x in columns])


def overlaps(tables: Mapping[str, DataFrame], unique: list[tuple[str, str]], printed: bool = False) -> DataFrame:
    """(fk_table, fk_column, pk_table, pk_column, common): how many values a column shares with a unique one of its type.

    Each column is scanned alone and its values become 64-bit hashes (numbers alike whatever their type). One aggregate by
    (type, hash) notes in bits which columns hold a value; the few distinct sets of columns are then paired. So all
    columns of all tables are compared in one shuffle, in which repeats are gone already. printed: as in ``hashed``.
    """
    columns = columns_of(tables)
    words = range(-(-len(columns) // WORD_BITS))
    cells = []
    for i, (t, c, kind) in enumerate(columns):
        x = valued(c, kind)
        bits = [F.lit(1 << i % WORD_BITS if i // WORD_BITS == w else 0).cast("long").alias(f"w{w}") for w in words]
        cells.append(tables[t].where(x.isNotNull()).select(F.lit(kind).alias("kind"), hashed(x, kind, printed).alias("h"), *bits))
    held = reduce(DataFrame.unionByName, cells).groupBy("kind", "h").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words])
    sets = held.groupBy(*[f"w{w}" for w in words]).agg(F.count(F.lit(1)).alias("n"))
    has = lambda i: F.getbit(f"w{i // WORD_BITS}", F.lit(i % WORD_BITS)) == 1
    named = lambda i: F.struct(F.lit(i).alias("i"), F.lit(columns[i][0]).alias("table"), F.lit(columns[i][1]).alias("column"))
    chosen = [i for i, (t, c, _) in enumerate(columns) if (t, c) in set(unique)]
    of = lambda which: F.explode(F.array_compact(F.array(*[F.when(has(i), named(i)) for i in which])))
    pairs = sets.select("*", of(chosen).alias("pk")).select("n", "pk", of(range(len(columns))).alias("fk")).where("fk.table <> pk.table")
    return pairs.groupBy(*[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("fk", "pk") for x in ("table", "column")]).agg(F.sum("n").alias("common"))


def name_similarity(fk_column: str, pk_table: str, pk_column: str) -> float:
    """From 0 to 1: of the names, of the names without id suffixes, or 1 if the foreign name is that of the table."""
    a, b = SUFFIX.sub("", fk_column.lower()), SUFFIX.sub("", pk_column.lower())
    if a and a in (pk_table.lower(), pk_table.lower().removesuffix("s")):
        return 1.0
    return max(ratio(fk_column.lower(), pk_column.lower()), ratio(a, b) if a and b else 0.0) / 100


def weakness(similarity: float) -> float:
    """How much of a coincidence penalty holds: none for alike names, half at least for a fairly alike one, all for others."""
    if similarity >= NAME_STRONG:
        return 0.0
    return 1.0 if similarity <= NAME_WEAK else (NAME_STRONG - similarity) / (NAME_STRONG - NAME_WEAK)


def scored(fk: Mapping, pk: Mapping, common: int) -> Edge | None:
    """The edge of two profiled columns, or None if it is too weak."""
    contained = common / fk["distinct_count"] if fk["distinct_count"] else 0.0
    if not contained or pk["distinct_count"] < 2 or not pk["is_unique"]:
        return None
    similar = name_similarity(fk["column"], pk["table"], pk["column"])
    repeats = fk["distinct_count"] < fk["filled"]
    score = W_CONTAINED * contained + W_CARDINALITY * (contained >= 0.5) + W_TYPE + W_NAME * similar
    score = min(1.0, score + REPEATS_BONUS * repeats)
    few = repeats and fk["distinct_count"] <= FEW
    if fk["role"] == "measure" and few and fk["whole"] and pk["whole"]:
        low, high = pk["numeric_min"], pk["numeric_max"]
        dense = pk["distinct_count"] >= DENSE * (high - low + 1)
        if dense and fk["numeric_min"] >= low and fk["numeric_max"] <= high:
            score -= PENALTY * weakness(similar)
    if fk["role"] in ("dimension", "text") and fk["dtype"] == "text" and few and not fk["is_id"] and not ID_NAME.search(fk["column"].lower()) and contained >= 0.5:
        score -= PENALTY * weakness(similar)
    if score < KEPT_AT:
        return None
    label = "high" if score >= HIGH_AT else "medium" if score >= MEDIUM_AT else "low"
    return Edge(fk["table"], fk["column"], pk["table"], pk["column"], round(score, 4), label, contained, similar)


def discover(tables: Mapping[str, DataFrame], profiles: list[Mapping] | None = None) -> list[Edge]:
    """All edges, the best orientation of each pair of columns, strongest first. Profiles and overlaps are a row a column pair."""
    if profiles is None:
        profiles = [r.asDict() for t, df in tables.items() for r in profile(df, t).collect()]
    by = {(p["table"], p["column"]): p for p in profiles}
    unique = [k for k, p in by.items() if p["is_unique"] and p["distinct_count"] > 1]
    if len(tables) < 2 or not unique:
        return []
    at = {t: i for i, t in enumerate(tables)}
    best: dict[frozenset, tuple[float, int, Edge]] = {}
    for r in overlaps(tables, unique).collect():
        fk, pk = (r["fk_table"], r["fk_column"]), (r["pk_table"], r["pk_column"])
        edge = scored(by[fk], by[pk], r["common"]) if fk in by else None
        if edge:
            rank = (edge.confidence, -int(at[fk[0]] > at[pk[0]]))
            pair = frozenset((fk, pk))
            if pair not in best or rank > best[pair][:2]:
                best[pair] = (*rank, edge)
    order = {p: i for i, p in enumerate(combinations(tables, 2))}
    place = lambda e: order[(e.fk_table, e.pk_table)] if (e.fk_table, e.pk_table) in order else order[(e.pk_table, e.fk_table)]
    return sorted((e for *_, e in best.values()), key=lambda e: (-e.confidence, place(e), e.fk_column, e.pk_column))


def mark_foreign(profiles: list[dict], edges: list[Edge]) -> None:
    """Profiles of columns that refer to another get ``is_fk``, true; all others false."""
    foreign = {(e.fk_table, e.fk_column) for e in edges}
    for p in profiles:
        p["is_fk"] = (p["table"], p["column"]) in foreign
