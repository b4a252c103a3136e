"""From a question's words to the tables and columns it is about; all of it on the driver, over the contract alone."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .contract import ColumnContract, Contract

#: Words that name nothing in a schema, aggregate words among them.
STOPWORDS = frozenset(
    "the and for are was were with from that this what which how many much show list give get all per each have has had did does into over than "
    "between average avg total sum count number top most least last first group order where when who their there them they our your find tell about".split()
)
#: Words for money in questions, and hints of it in columns.
MONEY_WORDS = frozenset("revenue revenues sales turnover earnings income takings proceeds billings receipts grossings".split())
MONEY_HINTS = frozenset(
    "amount amt price cost revenue sales value total fee charge charges payment payments paid spend spent balance income earnings turnover subtotal "
    "gross net usd eur gbp dollars money".split()
)
DESTRUCTIVE = re.compile(
    r"\b(drop|truncate)\s+(the\s+|all\s+|every\s+|my\s+)*(\w+\s+)?(table|tables|database|schema|column|data|rows?)\b"
    r"|\b(delete|erase|wipe|purge|destroy)\b(?!d)|\bremove\s+(all|every|the\s+rows?|rows?|records?|data|them|everything)\b"
    r"|\b(insert|update|overwrite|modify|alter|rename)\s+(\w+\s+){0,3}(into|table|tables|row|rows|record|records|column|columns|data|set|value|values|database)\b|\bset\s+\w+\s+to\b",
    re.I,
)


def tokens(text: str) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) >= 3 and w not in STOPWORDS]


def singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def same_word(a: str, b: str) -> bool:
    return a == b or singular(a) == singular(b)


def destructive(question: str) -> bool:
    """True if the question asks to change data."""
    return DESTRUCTIVE.search(question) is not None


@dataclass
class Relevant:
    """What a question is about. anchors: the tables that it names or whose columns it names; tables: with those between them."""

    anchors: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    columns: dict[str, list[str]] = field(default_factory=dict)
    named: list[tuple[str, str]] = field(default_factory=list)
    edges: list = field(default_factory=list)
    clarify: str | None = None
    options: list[str] = field(default_factory=list)
    unreachable: list[str] = field(default_factory=list)


def is_money(column: ColumnContract) -> bool:
    words = set(re.findall(r"[a-z0-9]+", f"{column.name} {column.meaning}".lower()))
    return column.role == "measure" and column.dtype == "numeric" and bool(words & MONEY_HINTS)


def named_in(column: ColumnContract, asked: list[str]) -> bool:
    words = re.findall(r"[a-z0-9]+", f"{column.name} {column.raw_name} {column.meaning}".lower().replace("_", " "))
    return any(same_word(w, q) for w in words if len(w) >= 3 and w not in STOPWORDS for q in asked)


def relevant(question: str, contract: Contract) -> Relevant:
    """Tables and columns that the question names, money words resolved, joined up along active links."""
    asked = tokens(question)
    out = Relevant()
    anchors = [t for t in contract.tables if any(same_word(t.lower(), q) for q in asked)]
    for t, tc in contract.tables.items():
        out.named += [(t, c.name) for c in tc.columns.values() if named_in(c, asked)]
    money = [(t, c.name) for t, tc in contract.tables.items() for c in tc.columns.values() if is_money(c)]
    if any(w in MONEY_WORDS for w in re.findall(r"[a-z0-9]+", question.lower())) and not any(x in money for x in out.named):
        if len(money) == 1:
            out.named += money
        elif len(money) > 1:
            out.options = [f"{t}.{c}" for t, c in money]
            out.clarify = f"Which column is meant: {', '.join(out.options)}?"
            return out
    anchors += [t for t, _ in out.named if t not in anchors]
    out.anchors = list(dict.fromkeys(anchors))
    out.tables, out.edges, out.unreachable = contract.graph.path(anchors)
    out.tables += out.unreachable
    out.columns = {t: list(contract.tables[t].columns) for t in out.tables}
    return out


def unsettled(found: Relevant, contract: Contract) -> list[ColumnContract]:
    """Provisional columns of all tables on the path; they must be settled before an answer."""
    return [c for t in found.tables for c in contract.tables[t].columns.values() if c.provisional]


def digest(contract: Contract, tables: list[str] | None = None) -> str:
    """The schema as text, for whatever writes SQL: columns with roles, a few samples, and active links alone."""
    lines, chosen = [], list(contract.tables) if tables is None else tables
    for t in chosen:
        lines.append(f"table {t}")
        for c in contract.tables[t].columns.values():
            shown = f" e.g. {', '.join(map(str, c.samples[:6]))}" if c.samples and (c.role in ("dimension", "id", "text") or c.dtype == "boolean") else ""
            tags = ", ".join(x for x, on in ((c.dtype, True), (c.role, True), ("id", c.is_id), ("refers", c.is_fk), ("provisional", c.provisional)) if on)
            lines.append(f"  {c.name} ({tags}){' – ' + c.meaning if c.meaning else ''}{shown}")
    for e in contract.graph.active():
        if e.fk_table in chosen and e.pk_table in chosen:
            lines.append(f"link {e.fk_table}.{e.fk_column} = {e.pk_table}.{e.pk_column}")
    return "\n".join(lines)


def suggestions(contract: Contract) -> list[str]:
    """Up to four questions that the schema can answer."""
    out: list[str] = []
    for t, tc in contract.tables.items():
        measures = [c.name for c in tc.columns.values() if c.role == "measure"]
        dims = [c.name for c in tc.columns.values() if c.role == "dimension"]
        times = [c.name for c in tc.columns.values() if c.role == "timestamp"]
        if measures and dims:
            out.append(f"Total {measures[0]} by {dims[0]}")
        if measures and times:
            out.append(f"Trend of {measures[0]} over {times[0]}")
        if measures:
            out.append(f"Total {measures[0]} in {t}")
        out.append(f"How many rows are in {t}?")
    return list(dict.fromkeys(out))[:4]
