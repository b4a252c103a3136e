"""White space and null tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "no value" once trimmed and lower-cased.
NULL_TOKENS = ("", "-", "--", "?", "#n/a", "#na", "n/a", "n/a.", "na", "nan", "nil", "none", "null", "unknown")


def squeezed(c: Column) -> Column:
    """Runs of (Unicode) white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """The key under which spellings are compared."""
    return F.lower(F.trim(c))


def nulled(c: Column, extra: Iterable[str] = ()) -> Column:
    """NULL where a cell is a null token."""
    tokens = sorted({*NULL_TOKENS, *(t.strip().lower() for t in extra)})
    return F.when(~F.coalesce(folded(c).isin(tokens), F.lit(False)), c)
