"""Numbers as people write them: currency, thousands, parentheses, percent, k/m/b.

The parse is a chain of steps, each used several times by the next. ``with_numbers`` adds the steps as columns, so that
generated code computes each once; ``parsed_number`` binds them within one expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENCY = "$€₹£¥₩₺"
FLOAT = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
INFINITE = r"^\s*[+-]?(inf|infinity)\s*$"
#: All characters that a number may be written with: text with others is none.
NUMBERISH = rf"^[\d\s+_.,()%{CURRENCY}eEkKmMbBiInNfFtTyY-]*+$"
WRAPPED = r"(?s)^\s*\((.*)\)\s*$"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def plain_float(c: Column) -> Column:
    """A double where the text is one, without any decoration; NULL else. Type suffixes like 1d are not numbers."""
    return F.when(c.rlike(FLOAT), F.regexp_replace(F.trim(c), "_", "").try_cast("double")).when(F.lower(c).rlike(INFINITE), F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def _bare(c: Column) -> Column:
    """Without parentheses, one leading currency symbol, percent signs and commas between thousands."""
    inner = F.trim(F.regexp_replace(c, WRAPPED, "$1"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, f"^[{CURRENCY}]", ""), "%+$", ""), r"(?<=\d),(?=\d{3})", "")


def _scaled(c: Column, bare: Column, body: Column) -> Column:
    """The value of the body, by the unit that bare ends with, the percent sign and the parentheses of the cell."""
    unit = F.lower(F.right(bare, F.lit(1)))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    percent = F.rtrim(F.regexp_replace(c, r"\)\s*$", "")).endswith("%")
    return plain_float(body) * scale / F.when(percent, 100.0).otherwise(1.0) * F.when(c.rlike(WRAPPED), -1.0).otherwise(1.0)


def _body(bare: Column) -> Column:
    return F.regexp_replace(bare, "[kKmMbB]$", "")


def with_numbers(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """df with a column of parsed numbers for each {text column: new column}.

    Cells that are plain numbers are cast, those with characters that no number has are NULL; only the others take all steps.
    """
    cols, keep = {s: F.col(f"`{s}`") for s in names}, df.columns
    df = df.withColumns({f"_bare_{o}": F.when(~cols[s].rlike(FLOAT) & cols[s].rlike(NUMBERISH), _bare(cols[s])) for s, o in names.items()})
    df = df.withColumns({f"_body_{o}": _body(F.col(f"`_bare_{o}`")) for o in names.values()})
    df = df.withColumns({o: F.when(F.col(f"`_bare_{o}`").isNull(), plain_float(cols[s])).otherwise(_scaled(cols[s], F.col(f"`_bare_{o}`"), F.col(f"`_body_{o}`"))) for s, o in names.items()})
    return df.select(*[F.col(f"`{c}`") for c in (*keep, *names.values())])


def parsed_number(c: Column) -> Column:
    """The number that a messy text stands for, NULL if none: ``($1,200)`` is -1200, ``10%`` 0.1, ``$2.5M`` 2500000."""
    return bound(c, lambda x: bound(_bare(x), lambda b: _scaled(x, b, _body(b))))
