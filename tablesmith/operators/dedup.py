"""Exact and near duplicate rows, and their removal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ISO
from ..functions.similarity import sorted_tokens, token_sort_ratio
from ..workers import ship
from .cleaning import data_columns
from .ledger import ROW_ID

ALIKE, DATE_SHARE = 85.0, 0.7
BLOCK_ROWS = 64


def _alike(df: DataFrame) -> list:
    """What rows are grouped by to find equal ones: all columns, NULLs equal each other."""
    return [F.col(f"`{c}`") for c in data_columns(df)] or [F.lit(0)]


def exact_groups(df: DataFrame) -> DataFrame:
    """(first, last, n) of rows that are equal in all columns: the least and greatest row id, and how many rows. No lists."""
    rows = df.groupBy(*_alike(df)).agg(F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1").select("first", "last", "n")


def exact_members(df: DataFrame) -> DataFrame:
    """(row_id, first): which group of ``exact_groups`` each row of one is in."""
    cols = data_columns(df)
    rows = df.select(F.col(f"`{ROW_ID}`").alias("row_id"), F.struct(*_alike(df)).alias("row"))
    groups = df.groupBy(*_alike(df)).agg(F.min(ROW_ID).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = groups.select("first", F.struct(*[F.col(f"`{c}`") for c in cols] or [F.lit(0)]).alias("other"))
    return rows.join(groups, F.col("row").eqNullSafe(F.col("other"))).select("row_id", "first")


def strict_columns(df: DataFrame) -> list[str]:
    """Columns that near duplicates must share: numbers, dates, booleans, and text that is mostly ISO dates."""
    typed = [c for c, t in df.dtypes if t != "string" and c != ROW_ID]
    texts = [c for c, t in df.dtypes if t == "string" and c != ROW_ID]
    if texts:
        row = df.agg(*[F.struct(F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`").rlike(ISO)).alias("iso")).alias(c) for c in texts]).first()
        typed += [c for c in texts if row[c]["n"] and row[c]["iso"] > DATE_SHARE * row[c]["n"]]
    return [c for c in data_columns(df) if c in typed]


def letter_keys(rows: DataFrame, texts: list[str], alike: float) -> DataFrame:
    """(_id, _s, _k, _n): any two rows of one block _s that are alike in all texts share a key _k. _n: the text's length.

    Keys are of the text of most values, its words sorted. With t = 1 - alike / 100, a pair that is alike leaves all but a
    share of max(4t / (1 + t), 2t / (1 - t)) of a text's length of its numbered letter pairs in the other, so the rarest
    so many and one more of both share one. Texts of one or two letters are alike only if equal. Below ALIKE that doesn't
    hold, and all rows of a block share a key. At 100 all texts have equal words, which are the key.
    """
    if alike >= 100:
        words = F.to_json(F.array(*[sorted_tokens(F.col(f"`{c}`")) for c in texts]))
        return rows.select(F.col(ROW_ID).alias("_id"), "_s", words.alias("_k"), F.lit(0).alias("_n"))
    if alike < ALIKE:
        return rows.select(F.col(ROW_ID).alias("_id"), "_s", F.lit("").alias("_k"), F.lit(0).alias("_n"))
    n = rows.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    column = texts[max(range(len(texts)), key=lambda i: n[i])]
    t = 1 - alike / 100
    lost = max(4 * t / (1 + t), 2 * t / (1 - t))
    words = rows.select(F.col(ROW_ID).alias("_id"), "_s", sorted_tokens(F.col(f"`{column}`")).alias("_t"))
    whole = words.where("_t is null or length(_t) < 3").select("_id", "_s", F.coalesce(F.concat(F.lit("="), "_t"), F.lit("null")).alias("_k"), F.coalesce(F.length("_t"), F.lit(0)).alias("_n"))
    at = F.explode(F.sequence(F.lit(1), F.length("_t") - 1)).alias("_at")
    grams = words.where("length(_t) > 2").select("_id", "_s", "_t", at).select("_id", "_s", F.length("_t").alias("_n"), F.expr("substring(_t, _at, 2)").alias("_g"), "_at")
    again = F.row_number().over(Window.partitionBy("_id", "_g").orderBy("_at"))
    grams = grams.select("_id", "_s", "_n", F.concat("_g", again.cast("string")).alias("_k"))
    ranked = grams.join(grams.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")), "_k")
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_m", "_k"))
    rare = ranked.withColumn("_p", place).where(F.col("_p") <= F.floor(F.col("_n") * lost + 1e-9) + 1)
    return whole.unionByName(rare.select("_id", "_s", "_k", "_n"))


def near_duplicates(df: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(row_a, row_b, similarity, differs) for pairs of rows with equal strict columns whose differing texts are all alike.

    Rows of equal strict values are a block. Rows of a small block all meet; those of one of more than BLOCK_ROWS (all rows,
    if there are no strict columns) meet only if they share a rare letter pair of one text column (``letter_keys``; at 100, the
    words of all) and their lengths allow the score. No pair is lost. Copies are first made one row, so equal rows never pair up.
    """
    ship(df.sparkSession)
    strict = strict_columns(df)
    texts = [c for c in data_columns(df) if c not in strict]
    if not texts:
        return df.sparkSession.createDataFrame([], "row_a long, row_b long, similarity double, differs array<string>")
    value = lambda c: F.round(F.col(f"`{c}`"), 9) if dict(df.dtypes)[c] in ("double", "float") else F.trim(F.col(f"`{c}`").cast("string"))
    rows = df.groupBy(*[F.col(f"`{c}`") for c in data_columns(df)]).agg(F.min(ROW_ID).alias(ROW_ID))
    rows = rows.withColumn("_s", F.to_json(F.struct(F.lit(0).alias("k"), *[value(c).alias(f"k{i}") for i, c in enumerate(strict)]), {"ignoreNullFields": "false"}))
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_b")).where("_b > 1")
    blocked = rows.join(sizes, "_s")
    few = blocked.where(F.col("_b") <= BLOCK_ROWS).select(F.col(ROW_ID).alias("_id"), "_s", F.lit("").alias("_k"), F.lit(0).alias("_n"))
    keys = few.unionByName(letter_keys(blocked.where(F.col("_b") > BLOCK_ROWS), texts, alike))
    x, y = keys.alias("x"), keys.alias("y")
    least = alike / (200 - alike)  # of two lengths, below which the score can't be reached
    near_lengths = F.least("x._n", "y._n") >= F.greatest("x._n", "y._n") * (least - 1e-9)
    pairs = x.join(y, (F.col("x._s") == F.col("y._s")) & (F.col("x._k") == F.col("y._k")) & (F.col("x._id") < F.col("y._id")) & near_lengths)
    pairs = pairs.select(F.col("x._id").alias("_a"), F.col("y._id").alias("_b")).distinct()
    side = lambda n: rows.select(F.col(ROW_ID).alias(f"_{n}"), F.struct(*[F.col(f"`{c}`") for c in texts]).alias(f"_row_{n}"))
    pairs = pairs.join(side("a"), "_a").join(side("b"), "_b")
    of = lambda n, c: F.col(f"_row_{n}.`{c}`")
    same = {c: F.trim(of("a", c)).eqNullSafe(F.trim(of("b", c))) for c in texts}
    score = F.least(*[F.when(s, 100.0).otherwise(F.coalesce(token_sort_ratio(of("a", c), of("b", c)), F.lit(0.0))) for c, s in same.items()], F.lit(100.0))
    differs = F.array_compact(F.array(*[F.when(~s, F.lit(c)) for c, s in same.items()]))
    out = pairs.select(F.col("_a").alias("row_a"), F.col("_b").alias("row_b"), (score / 100).alias("similarity"), differs.alias("differs"))
    return out.where((F.col("similarity") >= alike / 100) & (F.size("differs") > 0))


def removed(df: DataFrame, groups: Iterable[Iterable[int]], action: str = "remove") -> DataFrame:
    """Of each group of row ids the least stays. Unknown ids and groups of one change nothing; ids are numbered anew."""
    if action != "remove":
        return df
    gone = sorted({i for g in groups for i in sorted(set(g))[1:]})
    if not gone:
        return df
    ids = df.sparkSession.createDataFrame([(i,) for i in gone], f"{ROW_ID} long")
    return renumbered(df.join(ids, ROW_ID, "left_anti"))


def renumbered(df: DataFrame) -> DataFrame:
    """Row ids gapless from 0 in their old order: ranges first, then within, so no task sorts the table alone."""
    from .numbering import gapless

    return gapless(df, ROW_ID)
