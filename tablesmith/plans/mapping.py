"""A question's structure as data, made from its words or by a service, checked against the data, compiled to a plan."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .contract import Contract
from .question import MONEY_WORDS, Relevant, relevant, same_word, tokens

#: The aggregates and comparisons of a proposal, and words that ask for an aggregate.
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=")
WORDS = {
    "SUM": "total sum overall revenue sales spend spent turnover",
    "AVG": "average avg mean typical",
    "COUNT": "count many number",
    "MAX": "max maximum highest largest biggest",
    "MIN": "min minimum lowest smallest least",
}
COMPARISONS = {">": "over|above|more than|greater than|exceeding", "<": "under|below|less than|fewer than", ">=": "at least", "<=": "at most"}
#: Words that a question may hold besides names and values. Any other word that nothing explains is reported, never passed over.
FILLER = frozenset(
    "a all an and are as at be by can could did do does each every for from get give had has have how i in is it its list many me much my of on or "
    "our over per please records rows show so tell than that the their them there these they this those to trend us was we were what when where "
    "which who whose will with would you your find".split()
)
LONGEST_VALUE = 6


@dataclass
class Filter:
    table: str
    column: str
    op: str
    value: object


@dataclass
class Proposal:
    tables: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    aggregation: str | None = None
    measure: tuple[str, str] | None = None
    group_by: list[tuple[str, str]] = field(default_factory=list)
    confidence: str = "high"
    alternatives: list[dict] = field(default_factory=list)
    descending: bool = True
    limit: int | None = None
    unread: list[str] = field(default_factory=list)
    counted: str | None = None


def from_dict(raw: Mapping) -> Proposal:
    """A proposal as a service gives it; an unknown operator is taken as equality, an unknown aggregate as none."""
    split = lambda x: tuple(x.split(".", 1)) if isinstance(x, str) else tuple(x)
    agg = str(raw.get("aggregation") or "").upper()
    return Proposal(
        list(raw.get("tables", [])),
        [Filter(*split((f["table"], f["column"])), f.get("op") if f.get("op") in OPERATORS else "=", f.get("value")) for f in raw.get("filters", [])],
        agg if agg in AGGREGATES else None,
        split(raw["measure"]) if raw.get("measure") else None,
        [split(g) for g in raw.get("group_by", [])],
        raw.get("confidence", "high"),
        list(raw.get("alternatives", [])),
    )


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def plain(c):
    """Text as its lower-case words, a space between."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", " "))


def values_named(words: list[str], contract: Contract, frames: Mapping[str, DataFrame], tables: list[str]) -> dict[str, list[tuple[str, str, list[str]]]]:
    """The runs of words that are values of text columns of the tables: (table, column, values as they are, folded) for each.

    One aggregate a table looks at all of its rows; what it returns is bounded by the runs of a question.
    """
    runs = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + LONGEST_VALUE) + 1)}
    runs = sorted(r for r in runs if any(w not in FILLER for w in r.split()))
    found: dict[str, list] = {}
    for t in tables:
        names = [c.name for c in contract.tables[t].columns.values() if c.dtype == "text" and c.name in frames[t].columns] if t in frames else []
        if not names or not runs:
            continue
        hit = {c: plain(F.col(f"`{c}`")) for c in names}
        row = frames[t].agg(*[F.collect_set(F.when(x.isin(runs), F.struct(x.alias("run"), folded(F.col(f"`{c}`").cast("string")).alias("value")))).alias(f"c{i}") for i, (c, x) in enumerate(hit.items())]).first()
        for i, c in enumerate(names):
            by: dict[str, list[str]] = {}
            for r in row[f"c{i}"]:
                by.setdefault(r["run"], []).append(r["value"])
            for run, values in by.items():
                found.setdefault(run, []).append((t, c, sorted(values)))
    return found


def propose(question: str, contract: Contract, found: Relevant | None = None, frames: Mapping[str, DataFrame] | None = None) -> Proposal | None:
    """The proposal that a question's words make: an aggregate, a measure, groups, comparisons with numbers, and values.

    Values are looked for in the data itself (frames), in the tables that the question is about, or in all if it names none.
    Words that nothing explains are given back as ``unread``.
    """
    found = found or relevant(question, contract)
    low = question.lower()
    words = _words(question)
    at = {a: min((words.index(w) for w in names.split() if w in words), default=None) for a, names in WORDS.items()}
    asked = sorted((i, a) for a, i in at.items() if i is not None)
    agg = asked[0][1] if asked else None
    columns = {(t, c): contract.tables[t].columns[c] for t, c in found.named if t in found.tables}
    group: list[tuple[str, str]] = []
    if m := re.search(r"\b(?:by|per|for each|each|over)\s+(.+)", low):
        wanted = tokens(m[1])
        group = [k for k, c in columns.items() if c.role != "measure" and any(same_word(p, w) for w in wanted for p in _words(c.name))]
        names = [k for k in group if k[1] in m[1].replace(" ", "_")]
        group = (names or group)[:2]
    measure = next((k for k, c in columns.items() if c.role == "measure" and k not in group), None)
    if agg != "COUNT" and measure is None:
        agg = "COUNT" if agg else None
    if agg is None and measure:
        agg = "SUM"
    read = [w in FILLER or any(w in names.split() for names in WORDS.values()) or w in MONEY_WORDS for w in words]
    limit = None
    if m := re.search(r"\btop\s+(\d+)\b", low):
        limit = int(m[1])
        _mark(words, ["top", m[1]], read)
    filters: list[Filter] = []
    for op, how in COMPARISONS.items():
        for m in re.finditer(rf"\b({how})\s+(\d+(?:,\d{{3}})*(?:\.\d+)?)\b", low):
            if measure:
                filters.append(Filter(*measure, op, float(m[2].replace(",", ""))))
                _mark(words, _words(m[0]), read)
    tables, alternatives = list(found.tables), []
    taken: dict[tuple[str, str], list[str]] = {}
    schema = {w for t in found.anchors for w in (*_words(t), *(w + "s" for w in _words(t)))} | {w for _, c in [*columns, *([measure] if measure else [])] for w in _words(c)}
    named = lambda w: any(same_word(w, n) for n in schema)
    # The tables that the question is about first; the others only for words that are then left.
    for look in ([t for t in contract.tables if t in tables], [t for t in contract.tables if t not in tables]) if frames is not None else ():
        if not look or all(r or named(w) for w, r in zip(words, read, strict=True)):
            continue
        hits = values_named(words, contract, frames, look)
        for run in sorted(hits, key=lambda r: -len(r.split())):
            parts = run.split()
            i = next((i for i in range(len(words)) if words[i : i + len(parts)] == parts and not all(read[i : i + len(parts)])), None)
            if i is None or all(w in schema for w in parts):
                continue
            best = _preferred(hits[run], columns, found)
            if len(best) > 1:
                alternatives.append({"options": [f"{t}.{c}" for t, c, _ in best]})
            taken.setdefault(best[0][:2], []).extend(best[0][2])
            read[i : i + len(parts)] = [True] * len(parts)
    filters += [Filter(t, c, "=" if len(v) == 1 else "in", v[0] if len(v) == 1 else v) for (t, c), v in taken.items()]
    tables += dict.fromkeys(t for t, _ in taken if t not in tables)
    if not tables:
        return None
    used = {*group, *([measure] if measure else []), *((f.table, f.column) for f in filters)}
    names = {w for t in found.anchors for w in _words(t)} | {w for t, c in used for col in [contract.tables[t].columns[c]] for w in (*_words(c), *_words(col.raw_name), *_words(col.meaning), *_words(t))}
    unread = [w for w, r in zip(words, read, strict=True) if not r and not any(same_word(w, n) for n in names)]
    # Rows are counted of the table that the question names, wherever its groups and values are.
    asked_for = next((t for w in tokens(question) for t in contract.tables if same_word(t.lower(), w)), None)
    return Proposal(tables, filters, agg or "COUNT", measure, group, alternatives=alternatives, limit=limit, unread=unread, counted=None if measure else asked_for)


def _mark(words: list[str], parts: list[str], read: list[bool]) -> None:
    for i in range(len(words) - len(parts) + 1):
        if words[i : i + len(parts)] == parts:
            read[i : i + len(parts)] = [True] * len(parts)


def _preferred(hits: list[tuple], columns: Mapping, found: Relevant) -> list[tuple]:
    """Of the columns that hold a value: those that the question names, else those of tables that it names, else all."""
    for wanted in (lambda h: h[:2] in columns, lambda h: h[0] in found.anchors):
        if some := [h for h in hits if wanted(h)]:
            return some
    return hits


def validated(p: Proposal, contract: Contract, frames: Mapping[str, DataFrame]) -> tuple[bool, str]:
    """Whether all that a proposal names exists, values of equality filters included, and every word of a question is read.

    With how it was read, or what is wrong.
    """
    if p.unread:
        return False, f"nothing in the data explains: {', '.join(p.unread)}"
    for t in p.tables:
        if t not in contract.tables:
            return False, f"there is no table {t}"
    for t, c in [*([p.measure] if p.measure else []), *p.group_by, *((f.table, f.column) for f in p.filters)]:
        if t not in contract.tables or c not in contract.tables[t].columns:
            return False, f"there is no column {t}.{c}"
    for f in p.filters:
        if f.op in ("=", "!=") and isinstance(f.value, str):
            hit = frames[f.table].where(folded(F.col(f"`{f.column}`").cast("string")) == f.value.strip().lower()).limit(1)
            if hit.isEmpty():
                return False, f"{f.table}.{f.column} has no value {f.value!r}"
    read = f"{p.aggregation} of {p.measure[1] if p.measure else 'rows'}"
    if p.group_by:
        read += " by " + ", ".join(c for _, c in p.group_by)
    if p.filters:
        read += " where " + " and ".join(f"{f.column} {f.op} {f.value}" for f in p.filters)
    return True, f"Read as: {read}"


def ambiguous(p: Proposal) -> str | None:
    """A question back, if the proposal is unsure or has rivals."""
    for a in p.alternatives:
        if len(a.get("options", [])) > 1:
            return f"Which is meant: {', '.join(a['options'])}?"
    return "Could you say it with names of columns?" if p.confidence == "low" else None


def compiled(p: Proposal, contract: Contract, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The plan: tables along the join path, filters at their tables, one aggregate, a total order."""
    named = {t for t, _ in [*([p.measure] if p.measure else []), *p.group_by, *((f.table, f.column) for f in p.filters)]}
    needed = named | ({p.counted} if p.counted else set(p.tables[:1] if not (p.measure or p.group_by) else []))
    path, edges, lost = contract.graph.path(needed)
    if lost:
        raise ValueError(f"no link reaches {', '.join(lost)}")
    if p.measure and p.aggregation in ("SUM", "AVG", "COUNT") and (many := next((e.fk_table for e in edges if e.pk_table == p.measure[0]), None)):
        raise ValueError(f"rows of {p.measure[0]} would count once for each of their rows in {many}")
    used: dict[str, set[str]] = {t: set() for t in path}
    for t, c in [*([p.measure] if p.measure else []), *p.group_by, *((f.table, f.column) for f in p.filters)]:
        used[t].add(c)
    for e in edges:
        used[e.fk_table].add(e.fk_column)
        used[e.pk_table].add(e.pk_column)
    name = lambda t, c: f"{t}__{c}"

    def scan(t: str) -> DataFrame:
        df = frames[t]
        for f in p.filters:
            if f.table == t:
                c = F.col(f"`{f.column}`")
                if f.op == "in":
                    df = df.where(folded(c.cast("string")).isin(list(f.value)))
                elif isinstance(f.value, str) and f.op in ("=", "!="):
                    hit = folded(c.cast("string")) == f.value.strip().lower()
                    df = df.where(hit if f.op == "=" else ~hit)
                else:
                    df = df.where({"=": c == f.value, "!=": c != f.value, ">": c > f.value, "<": c < f.value, ">=": c >= f.value, "<=": c <= f.value}[f.op])
        return df.select(*[F.col(f"`{c}`").alias(name(t, c)) for c in sorted(used[t])])

    out, joined = scan(path[0]), {path[0]}
    for t, e in zip(path[1:], edges, strict=True):
        out = out.join(scan(t), F.col(name(e.fk_table, e.fk_column)) == F.col(name(e.pk_table, e.pk_column)))
        joined.add(t)
    x = F.col(name(*p.measure)) if p.measure else F.lit(1)
    # A counted table that others refer to has each row as often as they do: its rows are told apart by the key referred to.
    key = next((e.pk_column for e in edges if e.pk_table == p.counted), None) if p.counted and not p.measure else None
    if key:
        x = F.col(name(p.counted, key))
    agg = {"SUM": F.sum, "COUNT": F.count_distinct if key else F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[p.aggregation or "COUNT"](x)
    label = f"{(p.aggregation or 'COUNT').lower()}_{p.measure[1]}" if p.measure else "n"
    groups = [F.col(name(t, c)).alias(c) for t, c in p.group_by]
    out = out.groupBy(*groups).agg(agg.alias(label)) if groups else out.agg(agg.alias(label))
    if groups:
        out = out.orderBy(F.desc_nulls_last(label) if p.descending else F.asc_nulls_last(label), *[F.asc_nulls_last(c) for _, c in p.group_by])
    return out.limit(p.limit) if p.limit else out
