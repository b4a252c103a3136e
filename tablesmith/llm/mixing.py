"""Operator 1: mixing sources to target weights by Pfair scheduling, with earliest deadline first.

Rows of a source, in a seeded hash order, form blocks of ``block_rows`` rows; a slot takes one block. Target weights are
made whole numbers a_s of sum ``period``: their exact common multiple, or by largest remainders if a period is given or the
exact one is beyond LONGEST; the bound below then holds against the rounded shares. Block k (from 0) of a source may not be placed before slot
floor(k * period / a_s), its release, and must be before slot ceil((k + 1) * period / a_s), its deadline. Of the released
blocks the one with the earliest deadline is placed, ties by source name. The shares sum to one, so every deadline is met
and after any number of slots each source's blocks differ from its target by less than one. At each multiple of ``period``
all differences are zero, so one period of slots, made on the driver, holds for the whole corpus, and a row finds its slot
by arithmetic: nothing that grows with the data is gathered or sorted globally.

When a source runs out, a new phase starts in which the weights of those left are scaled to sum to one. So no row is
dropped or repeated; the bound holds within each phase.

Sources that ``weights`` doesn't name, null among them, share the class "*" (weight ``other``), so that the number of
classes is bounded by the parameter. Repeated rows and equal ids are rows of their own. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor, gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, numbered, partitions_for, table

REST = "*"
#: Target weights of the production mix: the hot source is held to a fifth.
WEIGHTS = {"src0": 0.2} | {f"src{i}": round(0.8 * (1 + i % 4) / 48, 4) for i in range(1, 20)}
OTHER = 0.01
BLOCK_ROWS = 16
LONGEST = 100_000
PLACE = ("mix_class", "block", "slot", "phase", "release", "deadline", "position")


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period``, at least one each, by largest remainders."""
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    i = 0
    while sum(out.values()) < period:
        out[order[i % len(order)]] += 1
        i += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -period, s))] -= 1
    return out


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in proportion to the weights as written in decimals; of sum LONGEST, rounded, if theirs is greater."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = lcm(*[x.denominator for x in exact.values()])
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = gcd(*whole.values())
    return {s: n // common for s, n in whole.items()} if 0 < sum(whole.values()) // max(common, 1) <= LONGEST and min(whole.values()) > 0 else shares(weights, LONGEST)


def release(k: int, a: int, period: int) -> int:
    return k * period // a


def deadline(k: int, a: int, period: int) -> int:
    return -(-(k + 1) * period // a)


def one_period(a: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks within one period: earliest deadline first among the released."""
    period = sum(a.values())
    waiting = [(0, s, 0) for s in sorted(a)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in a}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(k, a[s], period), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if k + 1 < a[s]:
            heapq.heappush(waiting, (release(k + 1, a[s], period), s, k + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> list[dict]:
    """Until all blocks are placed: the phase's first slot, length, shares, slots of a period, and blocks done before it."""
    done, out, first = dict.fromkeys(blocks, 0), [], 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        own = {s: weights[s] for s in left}
        a = shares(own, period) if period else exact_shares(own)
        p, slots = sum(a.values()), one_period(a)
        place = lambda s, k: k // a[s] * p + slots[s][k % a[s]]  # noqa: B023, E731
        length = min(place(s, n - 1) for s, n in left.items()) + 1
        took = {s: length // p * a[s] + sum(x < length % p for x in slots[s]) for s in left}
        out.append({"first": first, "length": length, "period": p, "shares": a, "slots": slots, "before": {s: done[s] for s in left}, "took": took})
        for s, n in took.items():
            done[s] += n
        first += length
    return out


def placed(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """Rows of docs as one struct ``_doc``, and their place in the mix: the columns of PLACE."""
    weights = dict(WEIGHTS if weights is None else weights) | {REST: other}
    spark = docs.sparkSession
    named = F.when(F.col("source").isin([w for w in weights if w != REST]), F.col("source")).otherwise(F.lit(REST))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(own, named.alias("_class"), F.col("source").alias("_source"), (F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")).alias("_id"))
    counts = {r["_class"]: r["count"] for r in rows.groupBy("_class").count().collect()}  # bounded by the parameter
    blocks = {s: ceil(n / block_rows) for s, n in counts.items()}
    plan = phases(blocks, weights, period)
    table_of_slots = [
        (s, i, p["before"][s], p["before"][s] + p["took"][s], p["first"], p["period"], p["shares"][s], p["slots"][s])
        for i, p in enumerate(plan)
        for s in p["shares"]
    ]
    # Bounded by the parameters: classes x phases rows, each with its share of a period.
    schedule = spark.createDataFrame(table_of_slots, "_class string, _phase int, _lo long, _hi long, _first long, _period long, _share long, _slots array<int>")
    short = []  # sources whose last block isn't full: the slots after it start that much earlier
    for s, n in counts.items():
        for p in plan:
            if s in p["shares"] and p["before"][s] + p["took"][s] == blocks[s] and n % block_rows:
                k = blocks[s] - 1 - p["before"][s]
                short.append((p["first"] + k // p["shares"][s] * p["period"] + p["slots"][s][k % p["shares"][s]], block_rows - n % block_rows))
    total = sum(counts.values())
    buckets = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, bucket_count(total, n))])[F.col("_class")] if counts else F.lit(1)
    ranked = numbered(rows, ["_class"], ["_id", "_source"], buckets, "_rank")
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long"))
    on = (F.col("d._class") == F.col("s._class")) & (F.col("d._block") >= F.col("s._lo")) & (F.col("d._block") < F.col("s._hi"))
    found = ranked.alias("d").join(F.broadcast(schedule).alias("s"), on).drop(F.col("s._class"))
    k = F.col("_block") - F.col("_lo")
    slot = F.col("_first") + F.floor(k / F.col("_share")) * F.col("_period") + F.element_at("_slots", (k % F.col("_share")).cast("int") + 1)
    gaps = F.lit(0).cast("long")
    for at, missing in short:
        gaps = gaps + F.when(F.col("slot") > at, missing).otherwise(0)
    return found.select(
        "_doc",
        F.col("_class").alias("mix_class"),
        F.col("_block").alias("block"),
        slot.cast("long").alias("slot"),
        F.col("_phase").alias("phase"),
        (F.col("_first") + F.floor(k * F.col("_period") / F.col("_share"))).cast("long").alias("release"),
        (F.col("_first") + F.ceil((k + 1) * F.col("_period") / F.col("_share"))).cast("long").alias("deadline"),
        F.col("_rank"),
    ).withColumn("position", (F.col("slot") * block_rows + F.col("_rank") % block_rows - gaps).cast("long")).select("_doc", *PLACE)


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """docs with the columns of PLACE: class, block, slot, phase, release, deadline and the gapless position from 0.

    Columns of docs that have one of these names are left out.
    """
    out = placed(docs, *args, **options)
    return out.select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c not in PLACE], *PLACE)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the production mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in the order of the mix: part files, and the rows in them, follow each other by position. No row goes.

    Positions are gapless, so a row's part is known from its own; nothing is sampled to find ranges.
    """
    parts, total = partitions_for(docs), max(docs.count(), 1)
    part = F.floor(F.col("position") * parts / total).cast("int")
    return placed(docs).withColumn("_part", part).repartitionById(parts, "_part").sortWithinPartitions("position").select("_doc.*")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL: dict[str, str] = {}
