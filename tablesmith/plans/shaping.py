"""Results for people: capped rows that JSON can hold, and how to draw them."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_safe(v):
    """NaN and infinities are null, times are ISO text, nested values likewise."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [json_safe(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return v


def records(df: DataFrame, most: int) -> list[dict]:
    """At most ``most`` rows as dicts."""
    return [{k: json_safe(v) for k, v in r.asDict(recursive=True).items()} for r in df.limit(most).collect()]


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def chart_hint(rows: Sequence[dict]) -> str:
    """single_value, line, bar or table, from the first row."""
    if not rows:
        return "table"
    first = list(rows[0].values())
    if len(rows) == 1 and len(first) == 1:
        return "single_value"
    dated = any(isinstance(v, str) and re.match(r"\d{4}-\d{2}(-\d{2})?", v) for v in first)
    if dated and any(map(_number, first)):
        return "line"
    return "bar" if len(first) == 2 and sum(map(_number, first)) == 1 else "table"


def chart_keys(rows: Sequence[dict]) -> dict:
    """x: first column that isn't all numbers; y: last that is; series: second that isn't."""
    if not rows:
        return {"x": None, "y": None, "series": None}
    numeric = [c for c in rows[0] if all(r[c] is None or _number(r[c]) for r in rows) and any(_number(r[c]) for r in rows)]
    others = [c for c in rows[0] if c not in numeric]
    return {"x": others[0] if others else None, "y": numeric[-1] if numeric else None, "series": others[1] if len(others) > 1 else None}


def chart_pivot(df: DataFrame, x: str, series: str, y: str) -> DataFrame:
    """Long to wide: the sum of y for each x and series; a null label is a dash."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return df.withColumn("_s", dash(series)).groupBy(dash(x).alias(x)).pivot("_s").agg(F.sum(y))
