"""A question to an answer: intent, relevance, proposal or written SQL, guard, result, and what to draw."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from .contract import Contract
from .guard import MAX_ROWS, Guard, missing_tables, status
from .mapping import Proposal, ambiguous, compiled, from_dict, propose, validated
from .question import destructive, digest, relevant, suggestions, unsettled
from .shaping import chart_hint, chart_keys, records

PROVIDER_DELAYS = (0.5, 1.0, 2.0, 4.0)


class RateLimited(Exception):
    """A service says: later."""


class Unavailable(Exception):
    """A service can't be reached just now."""


class Provider(Protocol):
    """A language service: one prompt in, text out."""

    def complete(self, prompt: str) -> str: ...


def json_of(text: str) -> dict:
    """The JSON object within a reply: without code fences, from the first brace to the last."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    a, z = body.find("{"), body.rfind("}")
    if a < 0 or z < a:
        raise ValueError("the reply holds no object")
    return json.loads(body[a : z + 1])


def patient(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep, delays: Sequence[float] = PROVIDER_DELAYS[:3]) -> str:
    """The call, tried again after each delay when it is rate limited, and for nothing else."""
    for d in delays:
        try:
            return call()
        except RateLimited:
            sleep(d)
    return call()


class WithFallback:
    """The first provider; when it is out of reach or stays limited, the next. In privacy mode there is no next."""

    def __init__(self, *providers: Provider, private: bool = False, sleep: Callable[[float], None] = time.sleep) -> None:
        self.providers, self.sleep = providers[:1] if private else providers, sleep

    def complete(self, prompt: str) -> str:
        for i, p in enumerate(self.providers):
            try:
                return patient(lambda p=p: p.complete(prompt), self.sleep)
            except (RateLimited, Unavailable):
                if i + 1 == len(self.providers):
                    raise
        raise Unavailable("there is no provider")


@dataclass
class Answer:
    status: str
    text: str = ""
    sql: str = ""
    rows: list[dict] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    note: str = ""
    question: str | None = None
    options: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)
    chart: str = "table"
    chart_keys: dict = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)
    kind: str = ""
    followups: list[str] = field(default_factory=list)
    truncated: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


NARRATED_ROWS, FOLLOWUPS = 10, 3
#: Writes about a result: (question, statement, first rows, number of rows) to {"insight": text, "followups": [questions]}.
Narrator = Callable[[str, str, Sequence[dict], int], Mapping]


def insight(rows: Sequence[dict], question: str = "", sql: str = "", narrator: Narrator | None = None) -> tuple[str, list[str]]:
    """Text about a result, and up to FOLLOWUPS further questions. A narrator sees NARRATED_ROWS rows; if it fails, a count stands in."""
    plain = f"Query returned {len(rows)} row{'' if len(rows) == 1 else 's'}."
    if narrator is None:
        return plain, []
    try:
        said = narrator(question, sql, list(rows[:NARRATED_ROWS]), len(rows))
        return str(said.get("insight") or plain), [str(f) for f in said.get("followups") or []][:FOLLOWUPS]
    except Exception:  # noqa: BLE001 - a narrator is optional; the rows are given without it
        return plain, []


def shaped(df: DataFrame, most: int, question: str = "", narrator: Narrator | None = None, **more) -> Answer:
    """The answer that a plan's first ``most`` rows make; ``truncated`` if it has more."""
    rows = records(df, most + 1)
    rows, more["truncated"] = rows[:most], len(rows) > most
    text, followups = insight(rows, question, more.get("sql", ""), narrator)
    return Answer("answered", text, rows=rows, columns=df.columns, chart=chart_hint(rows), chart_keys=chart_keys(rows), followups=followups, **more)


def run_sql(sql: str, guard: Guard, required: Sequence[str] = (), contract: Contract | None = None, question: str = "", narrator: Narrator | None = None) -> Answer:
    """A written statement through the guard; refused if it leaves out a table that the question needs."""
    v = guard.check(sql)
    hints = suggestions(contract) if contract and not v.ok else []
    if not v.ok:
        return Answer(status(v), v.reason, sql=sql, kind=v.kind, suggestions=hints, tables=v.tables)
    if left_out := missing_tables(v, required):
        return Answer("refused", f"the statement leaves out {', '.join(left_out)}", sql=v.sql, kind="incomplete", tables=v.tables)
    try:
        return shaped(guard.spark.sql(v.sql), guard.max_rows, question, narrator, sql=v.sql, tables=v.tables, kind="ok")
    except AnalysisException as e:
        return Answer("refused", str(e).splitlines()[0], sql=v.sql, kind="schema_mismatch", tables=v.tables)
    except PySparkException as e:
        return Answer("error", str(e).splitlines()[0][:300], sql=v.sql, kind="error", tables=v.tables)


def answer(
    question: str,
    contract: Contract,
    frames: Mapping[str, DataFrame],
    guard: Guard,
    writer: Callable[[str, str], str] | None = None,
    proposer: Callable[[str, str], Mapping] | None = None,
    narrator: Narrator | None = None,
) -> Answer:
    """The answer to a question. writer: writes SQL for a digest; proposer: proposes a mapping; without them words decide."""
    if destructive(question):
        return Answer("blocked", "this asks to change data; only reading is allowed", kind="destructive")
    found = relevant(question, contract)
    if found.clarify:
        return Answer("clarify", found.clarify, question=found.clarify, options=found.options)
    if found.tables:
        open_ = unsettled(found, contract)
        if open_:
            return Answer("clarify", open_[0].question or "", question=open_[0].question, options=[c.name for c in open_], tables=found.tables)
        if writer is not None:
            return run_sql(writer(question, digest(contract, found.tables)), guard, found.tables, contract, question, narrator)
        proposal: Proposal | None = propose(question, contract, found, frames)
    elif proposer:
        proposal = from_dict(proposer(question, digest(contract)))
    else:
        proposal = propose(question, contract, found, frames)
    if proposal is None:
        return Answer("refused", "the question names nothing in the data", kind="schema_mismatch", suggestions=suggestions(contract))
    ok, note = validated(proposal, contract, frames)
    if not ok:
        return Answer("refused", note, kind="schema_mismatch", suggestions=suggestions(contract))
    if back := ambiguous(proposal):
        return Answer("clarify", back, question=back, note=note)
    try:
        return shaped(compiled(proposal, contract, frames), MAX_ROWS, question, narrator, note=note, tables=proposal.tables, kind="ok")
    except ValueError as e:
        return Answer("refused", str(e), kind="incomplete", suggestions=suggestions(contract))
