"""The schema contract: what each column is, how sure that is, and what a person should settle first."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from ..operators.cleaning import Flag
from .graph import Graph

#: How sure the heuristics are of a column by its role, and what takes from that.
BY_ROLE = {"id": 0.9, "timestamp": 0.8, "measure": 0.78, "dimension": 0.7, "text": 0.55}
SHORT_NAME, SHORT_COST, NULL_COST, NULL_MOST = 4, 0.2, 0.4, 0.2
PROVISIONAL_UNDER, DICTIONARY = 0.55, 0.99


@dataclass
class ColumnContract:
    name: str
    dtype: str
    role: str
    confidence: float
    meaning: str = ""
    raw_name: str = ""
    provisional: bool = False
    question: str | None = None
    samples: list = field(default_factory=list)
    unit: str = ""
    is_id: bool = False
    is_fk: bool = False


@dataclass
class TableContract:
    name: str
    columns: dict[str, ColumnContract]
    rows: int = 0


@dataclass
class Contract:
    tables: dict[str, TableContract]
    graph: Graph

    def schema(self) -> dict[str, set[str]]:
        return {t: set(c.columns) for t, c in self.tables.items()}

    def edge_provisional(self) -> list[tuple]:
        return [e.key for e in self.graph.edges if e.label != "high"]


def confidence(profile: Mapping) -> float:
    """How sure the heuristics are of a profiled column, from 0.05 to 1."""
    out = BY_ROLE.get(profile["role"], 0.55)
    if profile["role"] != "id" and len(profile["column"]) <= SHORT_NAME and "_" not in profile["column"]:
        out -= SHORT_COST
    out -= min(NULL_MOST, NULL_COST * profile["null_pct"])
    return round(min(1.0, max(0.05, out)), 4)


def build(profiles: Iterable[Mapping], graph: Graph, flags: Iterable[Flag] = (), labels: Callable[[list[Mapping]], Mapping] | None = None, raw_names: Mapping | None = None) -> Contract:
    """The contract of profiled tables. labels: an optional call that names meanings; it may fail, and then names none."""
    profiles, flags = list(profiles), list(flags)
    try:
        named = dict(labels(profiles)) if labels else {}
    except Exception:  # noqa: BLE001 - a label service is optional
        named = {}
    tables: dict[str, TableContract] = {}
    for p in profiles:
        key = (p["table"], p["column"])
        label = named.get(key, {})
        sure = float(label.get("confidence", confidence(p)))
        flagged = next((f for f in flags if (f.table, f.column) == key), None)
        provisional = sure < PROVISIONAL_UNDER or flagged is not None
        question = None
        if provisional:
            question = f"{p['column']}: {flagged.detail or flagged.kind}?" if flagged else f"What does {p['table']}.{p['column']} mean?"
        column = ColumnContract(p["column"], p["dtype"], p["role"], sure, label.get("meaning", ""), (raw_names or {}).get(key, p["column"]), provisional, question, list(p.get("samples") or []), is_id=bool(p.get("is_id")), is_fk=bool(p.get("is_fk")))
        tables.setdefault(p["table"], TableContract(p["table"], {}, p["n"])).columns[p["column"]] = column
    return Contract(tables, graph)


def confirm(contract: Contract, edits: Iterable[Mapping] = (), dictionary: Mapping[str, str] | None = None, links: Iterable[tuple] = (), manual: Iterable[tuple] = ()) -> Contract:
    """A person's word: column edits, then dictionary meanings, then link choices, then declared links.

    Everything is checked before anything is changed; an unknown name raises KeyError.
    """
    edits, dictionary, links, manual = list(edits), dict(dictionary or {}), list(links), list(manual)
    known = {k for e in contract.graph.edges for k in (e.key,)}
    for e in edits:
        if e["column"] not in contract.tables[e["table"]].columns:
            raise KeyError(e["column"])
    for name in dictionary:
        t, _, c = name.rpartition(".")
        if not any(c in x.columns for x in contract.tables.values() if t in ("", x.name)):
            raise KeyError(name)
    for k in links:
        if tuple(k) not in known:
            raise KeyError(k)
    for k in manual:
        if k[0] == k[2] or k[1] not in contract.tables[k[0]].columns or k[3] not in contract.tables[k[2]].columns:
            raise KeyError(k)
    for e in edits:
        column = contract.tables[e["table"]].columns[e["column"]]
        for k in ("meaning", "role", "dtype", "unit"):
            if e.get(k):
                setattr(column, k, e[k])
        column.provisional, column.question, column.confidence = False, None, max(column.confidence, 0.95)
    for name, meaning in dictionary.items():
        t, _, c = name.rpartition(".")
        for x in contract.tables.values():
            if t in ("", x.name) and c in x.columns:
                column = x.columns[c]
                column.meaning, column.confidence, column.provisional, column.question = meaning, DICTIONARY, False, None
    for k in links:
        contract.graph.set_active(*k)
    for k in manual:
        contract.graph.add_manual(contract.schema(), *k)
    return contract
