"""Rules a person adds: null tokens, forced types, merged values. Checked first, applied in a fixed order, all or none."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .cleaning import TYPES
from .ledger import Change, Ledger, recorded

KINDS = ("null_token", "force_type", "merge_values")
MERGE_SAMPLES = 3


class RuleError(ValueError):
    """A rule that can't be applied; none is."""


@dataclass
class Rule:
    kind: str
    table: str | None = None
    column: str | None = None
    value: str | None = None
    values: list[str] = field(default_factory=list)


def checked(rules: Iterable[Rule], schema: Mapping[str, Iterable[str]]) -> list[Rule]:
    """The rules, if all of them can be applied to tables of this schema."""
    rules = list(rules)
    for r in rules:
        if r.kind not in KINDS:
            raise RuleError(f"unknown rule {r.kind!r}")
        if r.table is not None and r.table not in schema:
            raise RuleError(f"unknown table {r.table!r}")
        if not r.column:
            raise RuleError("a rule needs a column")
        if not targets(r, schema):
            raise RuleError(f"unknown column {r.column!r}")
        if r.kind == "force_type" and r.value not in TYPES:
            raise RuleError(f"unknown type {r.value!r}")
        if r.kind != "force_type" and not (r.value or "").strip():
            raise RuleError(f"{r.kind} needs a value")
        if r.kind == "merge_values" and not any(v.strip() for v in r.values):
            raise RuleError("merge_values needs values to merge")
    return rules


def targets(rule: Rule, schema: Mapping[str, Iterable[str]]) -> list[str]:
    """The tables a rule is for: the named one, or every one that has the column."""
    return [t for t, cols in schema.items() if rule.table in (None, t) and rule.column in set(cols)]


def slots(rules: Iterable[Rule], schema: Mapping[str, Iterable[str]]) -> dict[str, dict]:
    """For each table: extra null tokens (of the whole table), forced types, merges in order."""
    out: dict[str, dict] = {t: {"null_tokens": [], "types": {}, "merges": []} for t in schema}
    for r in rules:
        for t in targets(r, schema):
            if r.kind == "null_token":
                out[t]["null_tokens"].append(r.value)
            elif r.kind == "force_type":
                out[t]["types"][r.column] = r.value
            else:
                out[t]["merges"].append(r)
    return out


def merged(df: DataFrame, table: str, merges: Iterable[Rule]) -> tuple[DataFrame, Ledger]:
    """The table with each merge's values replaced by its label, whatever their case."""
    ledger = Ledger()
    for r in merges:
        c = F.col(f"`{r.column}`").cast("string")
        hit = folded(c).isin(*sorted({v.strip().lower() for v in r.values if v.strip()}))
        ledger.records += recorded(df, table, [Change(r.column, f"merge category values → '{r.value}'", hit & (c != r.value), c, F.lit(r.value))], MERGE_SAMPLES).records
        df = df.withColumn(r.column, F.when(hit, F.lit(r.value)).otherwise(c))
    return df, ledger
