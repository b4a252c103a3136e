"""Indel similarity: twice the longest common subsequence over the summed lengths, from 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of b's matches at a time (bit-parallel)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & where.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def sorted_tokens(c: Column) -> Column:
    """Lower case, all but letters and digits to spaces, words sorted."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of the sorted words. Sorting stays in the JVM; only the subsequence is Python, in Arrow batches."""
    return _ratio(sorted_tokens(a), sorted_tokens(b))
