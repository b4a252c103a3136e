"""Cleaning of files as they arrive: the votes of a first batch are frozen, the same expressions run on the stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.booleans import parsed_boolean
from ..functions.dates import parsed_date
from ..functions.numbers import parsed_number
from ..functions.text import nulled, squeezed


def frozen(df: DataFrame, types: Mapping[str, str], date_orders: Mapping[str, str | None] | None = None) -> DataFrame:
    """Columns of text typed as decided before; cells that don't fit are NULL, as a stream can't change its mind."""
    orders, out = date_orders or {}, []
    for c in df.columns:
        x = nulled(squeezed(F.col(f"`{c}`").cast("string")))
        kind = types.get(c)
        value = {"numeric": lambda x=x: parsed_number(x), "boolean": lambda x=x: parsed_boolean(x), "date": lambda x=x, c=c: parsed_date(x, orders.get(c))}.get(kind, lambda x=x: x)()
        out.append((value if kind else F.col(f"`{c}`")).alias(c))
    return df.select(*out)
