"""A workspace: uploaded and loaded tables, their cleaning, links and contract, and questions to them; and their registry."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import canonical, dedup, rules
from .operators.cleaning import Flag, clean, data_columns
from .operators.joins import discover, mark_foreign
from .operators.ledger import ROW_ID, Ledger
from .operators.profile import profile, samples
from .plans import contract as contracts
from .plans.answer import Answer, answer, run_sql
from .plans.graph import Graph
from .plans.guard import Guard, Metrics
from .sources import upload
from .sources.columnar import scan

IDLE_SECONDS = 1800


class SessionError(Exception):
    """There is no such session, or it has ended."""


class StateError(Exception):
    """The workspace isn't ready for this."""


@dataclass
class Report:
    """What an upload or a rule gave."""

    tables: dict[str, dict] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    ledger: Ledger = field(default_factory=Ledger)
    flags: list[Flag] = field(default_factory=list)
    lost_links: list[str] = field(default_factory=list)


class Workspace:
    """One person's tables, in a Spark session whose temporary views no other sees. Raw tables stay; rules plan anew from them."""

    def __init__(self, spark: SparkSession, metrics: Metrics | None = None) -> None:
        self.id, self.spark = str(uuid.uuid4()), spark.newSession()
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.metrics = metrics or Metrics()
        self.touched = time.monotonic()
        self.raw: dict[str, DataFrame] = {}
        self.raw_names: dict[str, list[str]] = {}
        self.ready: set[str] = set()
        self.tables: dict[str, DataFrame] = {}
        self.rules: list[rules.Rule] = []
        self.ledger, self.flags = Ledger(), []
        self.graph: Graph | None = None
        self.profiles: list[dict] | None = None
        self.contract: contracts.Contract | None = None
        self.questions = 0

    # Tables

    def upload(self, files: Iterable[tuple[str, bytes]]) -> Report:
        """Reads, cleans and links uploaded files; each fails alone. Links are found over all tables of the workspace."""
        found = upload.read(self.spark, files, self.raw)
        for t, df in found.tables.items():
            self.raw[t], self.raw_names[t] = df, found.raw_names[t]
        report = self._rebuild(found.tables)
        report.errors, report.notes = found.errors, found.notes
        return report

    def load(self, name: str, path: str, fmt: str = "parquet") -> Report:
        """A columnar table, taken as clean and typed."""
        self.raw[name] = scan(self.spark, path, fmt)
        self.ready.add(name)
        self.raw_names[name] = list(self.raw[name].columns)
        return self._rebuild([name])

    def _rebuild(self, names: Iterable[str]) -> Report:
        """Plans the named tables from raw with all rules, and forgets links and contract."""
        report = Report()
        slots = rules.slots(self.rules, {t: data_columns(df) for t, df in self.raw.items()})
        for t in names:
            if t in self.ready:
                self._adopt(t, self.raw[t])
                continue
            mine = slots[t]
            done = clean(self.raw[t], t, mine["types"], mine["null_tokens"])
            df, merged = canonical.canonicalize(done.df, t)
            df, forced = rules.merged(df, t, mine["merges"])
            report.ledger.records += done.ledger.records + merged.records + forced.records
            report.flags += done.flags
            self.flags = [f for f in self.flags if f.table != t] + done.flags
            self.ledger.records = [r for r in self.ledger.records if r.table != t] + done.ledger.records + merged.records + forced.records
            self._adopt(t, df)
        if self.graph is not None:
            report.lost_links = self.graph.lost_manual(discover(self.frames()))
        self.graph, self.profiles, self.contract = None, None, None
        for t in names:
            report.tables[t] = {"rows": self.tables[t].count(), "columns": data_columns(self.tables[t])}
        return report

    def _adopt(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.drop(ROW_ID).createOrReplaceTempView(name)

    def frames(self) -> dict[str, DataFrame]:
        return {t: df.drop(ROW_ID) for t, df in self.tables.items()}

    def apply_rules(self, new: Iterable[rules.Rule]) -> Report:
        """Adds rules, all or none, and rebuilds every table from raw; removed duplicates come back."""
        checked = rules.checked(new, {t: data_columns(df) for t, df in self.raw.items()})
        self.rules += checked
        return self._rebuild(list(self.raw))

    def duplicates(self, table: str) -> dict[str, DataFrame]:
        """Groups of equal rows, which row is in which, and pairs of nearly equal rows; none is removed."""
        df = self._with_ids(table)
        return {"exact": dedup.exact_groups(df), "members": dedup.exact_members(df), "near": dedup.near_duplicates(df)}

    def suggest(self, table: str) -> list[dict]:
        """Merges of values that a person may want; none is applied."""
        df = self.tables[table]
        return [s for c in canonical.eligible(df) for s in canonical.suggestions(df, c)]

    def resolve(self, table: str, groups: Iterable[Iterable[int]], action: str = "remove") -> int:
        """Of each group of row ids the first row stays. The contract is kept; profiles are taken anew."""
        if table not in self.tables:
            return 0
        before = self.tables[table].count()
        self._adopt(table, dedup.removed(self._with_ids(table), groups, action))
        self.profiles = None
        return before - self.tables[table].count()

    def _with_ids(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise StateError(f"there is no table {table}")
        df = self.tables[table]
        if ROW_ID not in df.columns:
            raise StateError("rows of columnar tables have no order")
        return df

    # Links and contract

    def profiled(self) -> list[dict]:
        if self.profiles is None:
            self.profiles = [r.asDict() for t, df in self.frames().items() for r in profile(df, t).collect()]
            shown = {t: samples(df, [p["column"] for p in self.profiles if p["table"] == t]) for t, df in self.tables.items()}
            for p in self.profiles:
                p["samples"] = shown[p["table"]].get(p["column"], [])
        return self.profiles

    def linked(self) -> Graph:
        if self.graph is None:
            profiles = self.profiled()
            edges = discover(self.frames(), profiles)
            mark_foreign(profiles, edges)
            self.graph = Graph(edges)
        return self.graph

    def schema(self, labels: Callable | None = None) -> contracts.Contract:
        if not self.tables:
            raise StateError("there are no tables yet")
        if self.contract is None:
            raw = {(t, c): r for t, names in self.raw_names.items() for c, r in zip(data_columns(self.tables[t]), names, strict=False)}
            self.contract = contracts.build(self.profiled(), self.linked(), self.flags, labels, raw)
        return self.contract

    def confirm(self, **word) -> contracts.Contract:
        return contracts.confirm(self.schema(), **word)

    # Questions

    def guard(self, keyed: bool = True, **options) -> Guard:
        return Guard(self.spark, self.tables, self.linked().edges if keyed else None, metrics=self.metrics, **options)

    def sql(self, statement: str, keyed: bool = False) -> Answer:
        """A person's own SELECT, guarded."""
        self.questions += 1
        return run_sql(statement, self.guard(keyed), contract=self.contract)

    def ask(self, question: str, writer: Callable | None = None, proposer: Callable | None = None, narrator: Callable | None = None) -> Answer:
        self.questions += 1
        return answer(question, self.schema(), self.frames(), self.guard(), writer, proposer, narrator)

    def wipe(self) -> None:
        """Forgets everything; may be called again."""
        for t in self.tables:
            self.spark.catalog.dropTempView(t)
        self.raw.clear()
        self.tables.clear()
        self.rules.clear()
        self.ready.clear()
        self.raw_names.clear()
        self.ledger, self.flags = Ledger(), []
        self.graph = self.profiles = self.contract = None


class Registry:
    """Workspaces by id; those idle too long end."""

    def __init__(self, spark: SparkSession, idle: float = IDLE_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.idle, self.clock = spark, idle, clock
        self.open: dict[str, Workspace] = {}
        self.created = 0
        self.metrics = Metrics()
        self.asked = 0
        self._lock = threading.Lock()

    def create(self) -> Workspace:
        w = Workspace(self.spark, self.metrics)
        w.touched = self.clock()
        with self._lock:
            self.open[w.id] = w
            self.created += 1
        return w

    def get(self, session_id: str) -> Workspace:
        self.sweep()
        with self._lock:
            if session_id not in self.open:
                raise SessionError(session_id)
            w = self.open[session_id]
            w.touched = self.clock()
            return w

    def end(self, session_id: str) -> bool:
        with self._lock:
            w = self.open.pop(session_id, None)
        if w is None:
            return False
        self.asked += w.questions
        w.wipe()
        return True

    def sweep(self) -> int:
        old = [i for i, w in list(self.open.items()) if self.clock() - w.touched > self.idle]
        return sum(self.end(i) for i in old)

    def report(self) -> Mapping:
        return {"sessions_open": len(self.open), "sessions_created": self.created, "questions": self.asked + sum(w.questions for w in self.open.values()), **self.metrics.as_dict()}
