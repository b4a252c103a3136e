"""The SQL guard: a statement is parsed by Catalyst, held against a whitelist of plan nodes, and rewritten where it must be.

Nothing is matched in the text: verbs, joins, relations and literals all come from the parsed, unresolved plan. Column names
are left to the analyzer. The order of checks is fixed, the first that fails names the verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import Edge

MAX_ROWS = 500
#: The logical nodes of a read-only statement.
READ_ONLY = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot "
    "Project Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedPivot UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot Window WithWindowDefinition UnresolvedOrdinal ResolvedInlineTable".split()
)
#: Join words of another dialect that Spark reads as table aliases.
FALSE_ALIASES = frozenset("asof positional anti semi".split())
#: Verbs of the optional strict mode, looked for in the text.
STRICT_WORDS = (
    "alter attach call checkpoint commit copy create delete detach drop execute export grant import insert install load merge pragma replace revoke "
    "rollback set truncate update vacuum".split()
)
HINTS = {
    r"\bqualify\b": "use a subquery with row_number()",
    r"\*\s*exclude\b": "write * EXCEPT (…)",
    r"\blimit\s+\d+\s*%": "give a number of rows",
    r"//": "write a div b",
    r"\busing\s+sample\b": "write TABLESAMPLE (… ROWS)",
    r"\bpivot\s+\w+\s+on\b": "write PIVOT (… FOR … IN (…))",
    r"\[": "write array(…)",
}


@dataclass
class Verdict:
    ok: bool
    kind: str
    reason: str = ""
    sql: str = ""
    tables: list[str] = field(default_factory=list)


@dataclass
class Metrics:
    """Counts of decisions; no statement is kept."""

    allowed: int = 0
    blocked: int = 0
    reasons: Counter = field(default_factory=Counter)
    tables: Counter = field(default_factory=Counter)

    def note(self, v: Verdict) -> Verdict:
        if v.ok:
            self.allowed += 1
        else:
            self.blocked += 1
            self.reasons[v.kind] += 1
        self.tables.update(v.tables)
        return v

    def as_dict(self) -> dict:
        n = self.allowed + self.blocked
        return {"allowed": self.allowed, "blocked": self.blocked, "allowed_pct": round(100 * self.allowed / n, 2) if n else 100.0, "reasons": dict(self.reasons), "tables": dict(self.tables)}


def _seq(s) -> Iterator:
    for i in range(s.size()):
        yield s.apply(i)


def _name(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def _span(x) -> tuple[int, int] | None:
    a, z = x.origin().startIndex(), x.origin().stopIndex()
    return (int(a.get()), int(z.get())) if a.isDefined() and z.isDefined() else None


class Statement:
    """A parsed statement: its plan nodes, expressions, relations, aliases and the names of its own tables."""

    def __init__(self, spark: SparkSession, sql: str) -> None:
        self.sql, self.nodes, self.expressions, self.ctes = sql, [], [], set()
        self.aliases: dict[str, str] = {}
        self.relations: list[tuple[str, ...]] = []
        self._walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))

    def _walk(self, node) -> None:
        name = _name(node)
        self.nodes.append((name, node))
        if name == "UnresolvedWith":
            for r in _seq(node.cteRelations()):
                self.ctes.add(r._1().lower())
                self._walk(r._2())
        elif name == "UnresolvedRelation":
            parts = tuple(_seq(node.multipartIdentifier()))
            self.relations.append(parts)
            if len(parts) == 1:
                self.aliases.setdefault(parts[0].lower(), parts[0].lower())
        elif name == "SubqueryAlias":
            child = node.child()
            if _name(child) == "UnresolvedRelation":
                self.aliases[node.alias().lower()] = list(_seq(child.multipartIdentifier()))[-1].lower()
            else:
                self.aliases[node.alias().lower()] = ""
        elif name == "LateralJoin":
            self._walk(node.right().plan())
        for e in _seq(node.expressions()):
            self._expression(e)
        for c in _seq(node.children()):
            self._walk(c)

    def _expression(self, e) -> None:
        name = _name(e)
        self.expressions.append((name, e))
        if name in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "UnresolvedTableArgPlanId"):
            inner = e.query().plan() if name == "InSubquery" else e.plan()
            self._walk(inner)
        for c in _seq(e.children()):
            self._expression(c)


def parse(spark: SparkSession, sql: str) -> Statement:
    return Statement(spark, sql)


def folded(stmt: Statement) -> str:
    """The statement with equality and IN between text columns and literals made blind to case, by splices at parsed places."""
    cuts: dict[tuple[int, int], str] = {}
    text = stmt.sql

    def literal(e) -> str | None:
        return str(e.value()) if _name(e) == "Literal" and e.dataType().typeName() == "string" and e.value() is not None else None

    def splice(column, values) -> None:
        spans = [_span(x) for x in (column, *values)]
        if all(spans):
            (a, z), *rest = spans
            cuts[(a, z)] = f"LOWER({text[a : z + 1]})"
            for a, z in rest:
                cuts[(a, z)] = text[a : z + 1].lower()

    for name, e in stmt.expressions:
        if name == "EqualTo":
            a, b = e.left(), e.right()
            for column, value in ((a, b), (b, a)):
                s = literal(value)
                if _name(column) == "UnresolvedAttribute" and s is not None and re.search(r"[^\W\d_]", s):
                    splice(column, [value])
        elif name == "In" and _name(e.value()) == "UnresolvedAttribute":
            values = list(_seq(e.list()))
            words = [literal(v) for v in values]
            if all(w is not None for w in words) and any(re.search(r"[^\W\d_]", w) for w in words):
                splice(e.value(), values)
    for (a, z), new in sorted(cuts.items(), reverse=True):
        text = text[:a] + new + text[z + 1 :]
    return text


class Guard:
    """Checks statements for a session whose tables are temporary views."""

    def __init__(self, spark: SparkSession, tables: Iterable[str], edges: Iterable[Edge] | None = None, max_rows: int = MAX_ROWS, strict: bool = False, metrics: Metrics | None = None) -> None:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.spark, self.tables, self.max_rows, self.strict = spark, {t.lower() for t in tables}, max_rows, strict
        self.edges = None if edges is None else [e for e in edges if e.active]
        self.metrics = metrics or Metrics()

    def check(self, sql: str) -> Verdict:
        """The verdict, with the rewritten statement if it may run."""
        return self.metrics.note(self._check(sql))

    def run(self, sql: str) -> tuple[Verdict, DataFrame | None]:
        """The verdict and, if it may run, at most max_rows rows as a plan."""
        v = self.check(sql)
        return v, self.spark.sql(v.sql).limit(self.max_rows) if v.ok else None

    def _check(self, sql: str) -> Verdict:
        sql = (sql or "").strip().rstrip(";").strip()
        if not sql:
            return Verdict(False, "destructive", "there is no statement")
        if self.strict and (m := re.search(rf"\b({'|'.join(STRICT_WORDS)})\b", sql, re.I)):
            return Verdict(False, "destructive", f"the word {m[1].upper()} isn't allowed")
        try:
            stmt = parse(self.spark, sql)
        except ParseException as e:
            verb = re.match(r"\W*(\w+)", sql)
            if ";" in sql or verb is None or verb[1].lower() not in ("select", "with", "from", "values"):
                return Verdict(False, "destructive", "only one SELECT statement is allowed")
            hint = next((h for p, h in HINTS.items() if re.search(p, sql, re.I)), str(e).strip().splitlines()[0][:200])
            return Verdict(False, "unsupported_syntax", hint)
        for name, _ in stmt.nodes:
            if name == "UnresolvedTableValuedFunction":
                return Verdict(False, "schema_mismatch", "table functions aren't allowed")
            if name not in READ_ONLY:
                return Verdict(False, "destructive", f"only reading is allowed, not {name}")
        for alias in stmt.aliases:
            if alias in FALSE_ALIASES:
                return Verdict(False, "unsupported_syntax", f"{alias.upper()} JOIN isn't a join of this dialect; use the as-of operator")
        if re.search(r"\bdistinct\s+on\s*\(", sql, re.I) and not stmt.relations:
            return Verdict(False, "unsupported_syntax", "DISTINCT ON: use a subquery with row_number()")
        used = []
        for parts in stmt.relations:
            if len(parts) != 1 or (parts[0].lower() not in self.tables and parts[0].lower() not in stmt.ctes):
                return Verdict(False, "schema_mismatch", f"there is no table {'.'.join(parts)}")
            if parts[0].lower() in self.tables and parts[0].lower() not in used:
                used.append(parts[0].lower())
        for name, node in stmt.nodes:
            if name != "Join":
                continue
            kind = node.joinType().toString()
            right = _name(node.right().child() if _name(node.right()) == "SubqueryAlias" else node.right())
            if right == "UnresolvedRelation" and node.condition().isEmpty() and not kind.startswith("UsingJoin"):
                return Verdict(False, "cross_join", "a join needs ON or USING", tables=used)
            if self.edges is not None and right == "UnresolvedRelation":
                reason = self._bad_key(node, kind, stmt)
                if reason:
                    return Verdict(False, "invalid_join_key", reason, tables=used)
        rewritten = folded(stmt)
        try:
            self.spark.sql(rewritten)
        except AnalysisException as e:
            return Verdict(False, "schema_mismatch", f"{e.getCondition()}: {str(e).splitlines()[0][:300]}", tables=used)
        except PySparkException as e:
            return Verdict(False, "unsupported_syntax", str(e).splitlines()[0][:300], tables=used)
        return Verdict(True, "ok", sql=rewritten, tables=used)

    def _bad_key(self, node, kind: str, stmt: Statement) -> str:
        """Why a join's keys are no active link; empty if they are one, or if nothing can be told."""
        allowed = {frozenset(((e.fk_table.lower(), e.fk_column.lower()), (e.pk_table.lower(), e.pk_column.lower()))) for e in self.edges}
        right = node.right()
        table = list(_seq((right.child() if _name(right) == "SubqueryAlias" else right).multipartIdentifier()))[-1].lower()
        if kind.startswith("UsingJoin"):
            names = [n.lower() for n in _seq(node.joinType().usingColumns())]
            ends = {c for pair in allowed for t, c in pair if t == table}
            missing = [n for n in names if n not in ends]
            return f"{table} isn't linked by {missing[0]}" if missing and table in self.tables else ""
        pairs = []

        def equalities(e) -> None:
            if _name(e) == "EqualTo" and _name(e.left()) == _name(e.right()) == "UnresolvedAttribute":
                ends = []
                for x in (e.left(), e.right()):
                    parts = [p.lower() for p in _seq(x.nameParts())]
                    owner = stmt.aliases.get(parts[0]) if len(parts) == 2 else None
                    ends.append((owner, parts[-1]) if owner in self.tables else None)
                if all(ends) and ends[0][0] != ends[1][0]:
                    pairs.append(frozenset(ends))
            for c in _seq(e.children()):
                equalities(c)

        if node.condition().isDefined():
            equalities(node.condition().get())
        if pairs and not any(p in allowed for p in pairs):
            return "no active link joins " + " and ".join(sorted(f"{t}.{c}" for t, c in pairs[0]))
        return ""


def missing_tables(verdict: Verdict, required: Iterable[str]) -> list[str]:
    """Tables that an answer must use and the statement doesn't."""
    return sorted({t.lower() for t in required} - set(verdict.tables))


def status(verdict: Verdict) -> str:
    """How an answer reports the verdict."""
    if verdict.ok:
        return "answered"
    return "refused" if verdict.kind in ("schema_mismatch", "cross_join", "invalid_join_key", "unsupported_syntax") else "blocked"
