"""Cleaning of string tables: white space, null tokens, type votes, coercion, flags, with a ledger of every change.

One aggregate over all columns gives all votes; one projection applies what was decided; one more aggregate counts what the
ledger says has changed. Votes are taken over all rows. Nullable booleans stay boolean; impossible calendar dates become NULL and count
as failures; cells that a numeric or boolean column can't parse keep the column text, with a flag.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.booleans import parsed_boolean
from ..functions.dates import ISO, SLASHED, looks_dated, order_votes, parsed_date, voted_order
from ..functions.numbers import plain_float, with_numbers
from ..functions.text import nulled, squeezed
from ..workers import spread
from .ledger import ROW_ID, Change, Ledger, counted, recorded

TYPES = ("numeric", "date", "boolean", "text")
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
NUMERIC_SHARE, DATE_SHARE, FAILED_SHARE = 0.7, 0.7, 0.3


@dataclass
class Flag:
    """Something about a column that a person should settle: date_order, mixed_type or coerce_failed."""

    table: str
    column: str
    kind: str
    detail: str = ""


@dataclass
class Cleaned:
    df: DataFrame
    types: dict[str, str]
    ledger: Ledger
    flags: list[Flag] = field(default_factory=list)
    date_orders: dict[str, str | None] = field(default_factory=dict)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def tidied(df: DataFrame, null_tokens: Iterable[str] = ()) -> DataFrame:
    """Every column as text, white space squeezed, null tokens NULL."""
    keep = [ROW_ID] if ROW_ID in df.columns else []
    return df.select(*keep, *[nulled(squeezed(F.col(f"`{c}`").cast("string")), null_tokens).alias(c) for c in data_columns(df)])


def vote(df: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of what each column's cells look like, in one pass over tidied text."""
    aggs = []
    for c in data_columns(df):
        x, number = F.col(f"`{c}`"), F.col(f"`_number_{c}`")
        counts = order_votes(x) | {
            "boolean": F.count_if(parsed_boolean(x).isNotNull()),
            "numeric": F.count(number),
            "whole": F.count_if(x.rlike(WHOLE)),
            "date": F.count_if(looks_dated(x)),
        }
        aggs += [v.alias(f"{k}:{c}") for k, v in counts.items()]
    if not aggs:
        return {}
    numbered = with_numbers(df, {c: f"_number_{c}" for c in data_columns(df)})
    out: dict[str, dict[str, int]] = {}
    for k, n in numbered.agg(*aggs).first().asDict().items():
        what, _, c = k.partition(":")
        out.setdefault(c, {})[what] = n
    return out


def decided_type(votes: Mapping[str, int]) -> str:
    """boolean if every cell is one, then numeric, then date by their shares, else text."""
    n = votes["filled"]
    if n and votes["boolean"] == n:
        return "boolean"
    if n and votes["numeric"] >= NUMERIC_SHARE * n:
        return "numeric"
    if n and votes["date"] >= DATE_SHARE * n:
        return "date"
    return "text"


def clean(df: DataFrame, table: str = "table", force_types: Mapping[str, str] | None = None, null_tokens: Iterable[str] = (), with_ledger: bool = True) -> Cleaned:
    """The typed table, the types, the ledger and the flags."""
    force_types, null_tokens = dict(force_types or {}), tuple(null_tokens)
    names, keep = data_columns(df), [ROW_ID] if ROW_ID in df.columns else []
    df = spread(df) if keep else df
    votes = vote(tidied(df, null_tokens))
    flags, orders, out, changes = [], {}, [], []
    types = {c: force_types.get(c) or decided_type(votes[c]) for c in names}
    # Each step is a projection of its own, so that what several expressions use is computed once.
    steps = df.select(*keep, *[F.col(f"`{c}`").cast("string").alias(f"raw:{c}") for c in names])
    steps = steps.withColumns({f"squeezed:{c}": squeezed(F.col(f"`raw:{c}`")) for c in names})
    steps = steps.withColumns({c: nulled(F.col(f"`squeezed:{c}`"), null_tokens) for c in names})
    steps = with_numbers(steps, {c: f"value:{c}" for c in names if types[c] == "numeric"})
    for c in names:
        if types[c] == "date":
            orders[c] = voted_order(votes[c])
            steps = steps.withColumn(f"value:{c}", parsed_date(F.col(f"`{c}`"), orders[c]))
        elif types[c] == "boolean":
            steps = steps.withColumn(f"value:{c}", parsed_boolean(F.col(f"`{c}`")))
    for c in names:
        v, kind = votes[c], types[c]
        raw, tidy, x, value = (F.col(f"`{p}{c}`") for p in ("raw:", "squeezed:", "", "value:"))
        changes.append(Change(c, "whitespace_trim", tidy != raw, raw, tidy))
        changes.append(Change(c, "null_normalize", raw.isNotNull() & x.isNull(), raw, F.lit(None)))
        if kind == "numeric":
            coerced, percent = value.isNotNull() & plain_float(x).isNull(), x.endswith("%")
            changes.append(Change(c, "numeric_coerce", coerced & ~percent, x, value))
            changes.append(Change(c, "percent_to_fraction", coerced & percent, x, value))
            if v["numeric"] == v["filled"]:
                out.append((value.cast("long") if v["whole"] == v["filled"] else value).alias(c))
            else:
                out.append(F.coalesce(value.cast("string"), x).alias(c))
                flags.append(Flag(table, c, "mixed_type", f"{v['filled'] - v['numeric']} of {v['filled']} cells are not numbers"))
                types[c] = "numeric" if c in force_types else "text"
        elif kind == "boolean":
            shown = F.initcap(value.cast("string"))
            changes.append(Change(c, "bool_normalize", value.isNotNull() & ~x.isin("True", "False"), x, shown))
            if v["boolean"] == v["filled"]:
                out.append(value.alias(c))
            else:
                out.append(F.coalesce(shown, x).alias(c))
                flags.append(Flag(table, c, "mixed_type", f"{v['filled'] - v['boolean']} of {v['filled']} cells are not booleans"))
        elif kind == "date":
            if orders[c] is None and v["slashed"]:
                flags.append(Flag(table, c, "date_order", "day and month can't be told apart; read as month first"))
            changes.append(Change(c, "date_normalize", value.isNotNull() & (value != x), x, value))
            out.append(F.when(x.rlike(ISO) | x.rlike(SLASHED), value).otherwise(F.coalesce(value, x)).alias(c))
        else:
            out.append(x.alias(c))
    failed = [F.count_if(F.col(f"`value:{c}`").isNull() & F.col(f"`{c}`").isNotNull()).alias(f"failed:{c}") for c in orders]
    measures = failed + (counted(changes) if with_ledger else [])
    counts = steps.agg(*measures).first().asDict() if measures else {}
    for c in orders:
        if (n := counts[f"failed:{c}"]) > FAILED_SHARE * votes[c]["filled"]:
            flags.append(Flag(table, c, "coerce_failed", f"{n} of {votes[c]['filled']} cells are no dates"))
    return Cleaned(steps.select(*keep, *out), types, recorded(steps, table, changes, counts=counts) if with_ledger else Ledger(), flags, orders)
