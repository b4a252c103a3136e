"""The graph of tables: which edges are active, and which tables a question must pass through."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from ..operators.joins import NAME_STRONG, Edge

#: The cost of an edge that only its values speak for; names, people and declarations cost one.
UNCONFIRMED = 20


class GraphError(ValueError):
    """A link that can't be made."""


class Graph:
    """Edges between tables; of each pair of tables at most one edge is active."""

    def __init__(self, edges: Iterable[Edge] = ()) -> None:
        self.edges = list(edges)
        self.seed()

    def seed(self) -> None:
        """Where a pair of tables has no active edge, its strongest becomes active (names alike first among equals)."""
        pairs: dict[frozenset, list[Edge]] = {}
        for e in self.edges:
            pairs.setdefault(frozenset((e.fk_table, e.pk_table)), []).append(e)
        for group in pairs.values():
            if not any(e.active for e in group):
                max(group, key=lambda e: (e.confidence, e.name_similarity)).active = True

    def active(self) -> list[Edge]:
        return [e for e in self.edges if e.active]

    def set_active(self, fk_table: str, fk_column: str, pk_table: str, pk_column: str) -> bool:
        """Makes exactly this edge the active one of its tables; False if there is none."""
        found = next((e for e in self.edges if e.key == (fk_table, fk_column, pk_table, pk_column)), None)
        if found is None:
            return False
        for e in self.edges:
            if {e.fk_table, e.pk_table} == {fk_table, pk_table}:
                e.active = e is found
        return True

    def add_manual(self, schema: dict[str, Iterable[str]], fk_table: str, fk_column: str, pk_table: str, pk_column: str) -> Edge:
        """An edge that a person declares: certain, and active."""
        if fk_table == pk_table:
            raise GraphError("a link needs two tables")
        for t, c in ((fk_table, fk_column), (pk_table, pk_column)):
            if t not in schema or c not in set(schema[t]):
                raise GraphError(f"unknown column {t}.{c}")
        key = (fk_table, fk_column, pk_table, pk_column)
        edge = next((e for e in self.edges if e.key == key), None)
        if edge is None:
            edge = Edge(*key, 1.0, "high")
            self.edges.append(edge)
        edge.confidence, edge.label, edge.manual = 1.0, "high", True
        self.set_active(*key)
        return edge

    def lost_manual(self, found: Iterable[Edge]) -> list[str]:
        """Declared links that discovery doesn't know, in either direction: those that a rebuild would lose."""
        known = {frozenset(((e.fk_table, e.fk_column), (e.pk_table, e.pk_column))) for e in found}
        mine = [e for e in self.edges if e.manual]
        return [f"{e.fk_table}.{e.fk_column} → {e.pk_table}.{e.pk_column}" for e in mine if frozenset(((e.fk_table, e.fk_column), (e.pk_table, e.pk_column))) not in known]

    def neighbours(self, table: str) -> dict[str, tuple[int, Edge]]:
        out = {}
        for e in self.active():
            if table in (e.fk_table, e.pk_table):
                other = e.pk_table if e.fk_table == table else e.fk_table
                sure = e.manual or e.name_similarity >= NAME_STRONG
                out[other] = (1 if sure else UNCONFIRMED, e)
        return dict(sorted(out.items()))

    def path(self, anchors: Iterable[str]) -> tuple[list[str], list[Edge], list[str]]:
        """Tables and edges that connect the anchors, growing from the first by the cheapest path; and anchors out of reach."""
        anchors = sorted(set(anchors))
        if not anchors:
            return [], [], []
        inside, edges, lost = [anchors[0]], [], []
        for goal in anchors[1:]:
            if goal in inside:
                continue
            heap: list[tuple[int, int, str, list]] = [(0, i, t, []) for i, t in enumerate(sorted(inside))]
            heapq.heapify(heap)
            done: set[str] = set()
            pushed = len(heap)
            while heap:
                cost, _, t, hops = heapq.heappop(heap)
                if t in done:
                    continue
                done.add(t)
                if t == goal:
                    for table, edge in hops:
                        if table not in inside:
                            inside.append(table)
                            edges.append(edge)
                    break
                for other, (step, edge) in self.neighbours(t).items():
                    if other not in done:
                        pushed += 1
                        heapq.heappush(heap, (cost + step, pushed, other, [*hops, (other, edge)]))
            else:
                lost.append(goal)
        return inside, edges, lost
