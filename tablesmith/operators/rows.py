"""Rows by conditions that a plain filter can't hold: windows (QUALIFY), and samples that are the same every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 8


def qualified(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition over window functions holds."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), condition.alias("holds"))
    return rows.where("holds").select("row.*")


def sampled(df: DataFrame, keys: list[str], share: float, seed: str = "") -> DataFrame:
    """About a share of the rows: those whose keys' MD5 is low. The same rows on every run, engine and layout, without a shuffle.

    Rows of equal keys are all in or all out; a NULL key counts as empty text.
    """
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    below = f"{min(int(share * 16**DIGITS), 16**DIGITS - 1):0{DIGITS}x}"
    return df if share >= 1 else df.where(F.substring(F.md5(text), 1, DIGITS) < below)
