"""Window functions, as-of joins, and the batch form of windowed stream aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.rows import qualified, sampled
from ..streaming.windows import drained, files, sessions, sliding, tumbling
from . import Query, planned, same, spelled

CENTS = "CAST(o_totalprice AS DECIMAL(18,2))"
STAMP = "%Y-%m-%d %H:%M:%S"


def _stamped(df, *cols):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in cols else F.col(c) for c in df.columns])


def _clicks_before_purchases(t, spark):
    events = t["events"].select("event_id", "user_id", "event_type", "ts")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"))
    return _stamped(asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_ts"]), "ts", "click_ts")


def _live(plan):
    """The plan over the events as a stream of files, run until all files are read; what it has written last."""

    def run(spark, folder):
        schema = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").schema
        return drained(plan(files(spark, folder, schema, only="events.parquet")))

    return run


def _top_orders(t, spark):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return qualified(t["orders"].select("o_custkey", "o_orderkey", "o_totalprice"), place <= 2).select("o_custkey", "o_orderkey")


QUERIES = {
    "window_qualify": planned(_top_orders, "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "sample_rows": planned(
        lambda t, s: sampled(t["lineitem"], ["l_orderkey", "l_linenumber"], 0.1, "a").select("l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE MD5('a' || CHR(31) || l_orderkey || CHR(31) || l_linenumber)[1:8] < '19999999'",
    ),
    "stream_tumbling_live": Query(
        _live(lambda d: _stamped(tumbling(d, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], "1 minute").drop("window_end"), "window_start")),
        f"SELECT STRFTIME(TIME_BUCKET(INTERVAL 1 HOUR, ts), '{STAMP}') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    ),
    "stream_sessions_live": Query(
        _live(lambda d: _stamped(sessions(d, "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")], "1 minute").drop("session_end"), "session_start")),
        f"SELECT STRFTIME(MIN(ts), '{STAMP}') AS session_start, user_id, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s "
        "FROM (SELECT user_id, ts, event_id, ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s",
    ),
    "window_ranks": spelled(
        "SELECT s_suppkey, ROW_NUMBER() OVER w AS rn, RANK() OVER v AS rk, DENSE_RANK() OVER v AS dr, NTILE(4) OVER w AS quarter FROM {supplier} "
        "WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), v AS (PARTITION BY s_nationkey ORDER BY FLOOR(s_acctbal / 1000))",
        "SELECT s_suppkey, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rn, CAST(RANK() OVER v AS INTEGER) AS rk, CAST(DENSE_RANK() OVER v AS INTEGER) AS dr, CAST(NTILE(4) OVER w AS INTEGER) AS quarter FROM {supplier} "
        "WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), v AS (PARTITION BY s_nationkey ORDER BY FLOOR(s_acctbal / 1000))",
    ),
    "window_lag_lead": same(
        "SELECT event_id, LAG(value) OVER w AS before, LEAD(value, 2) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
    ),
    "window_first_last": same(
        "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS first, LAST_VALUE(o_orderkey) OVER w AS last, NTH_VALUE(o_orderkey, 2) OVER w AS second FROM {orders} "
        "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ),
    "window_running": same(
        f"SELECT o_orderkey, CAST(SUM({CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running, "
        f"CAST(SUM({CENTS}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM {{orders}}"
    ),
    "window_range_interval": same("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}"),
    "window_share": same(
        f"SELECT o_orderkey, ROUND(CAST({CENTS} AS DOUBLE) / CAST(SUM({CENTS}) OVER (PARTITION BY o_custkey) AS DOUBLE), 6) AS share FROM {{orders}}"
    ),
    "top_k_per_group": same(
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3"
    ),
    "asof_click_before_purchase": planned(
        _clicks_before_purchases,
        f"SELECT p.event_id, p.user_id, STRFTIME(p.ts, '{STAMP}') AS ts, STRFTIME(c.ts, '{STAMP}') AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p "
        "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    ),
    "stream_tumbling": planned(
        lambda t, s: _stamped(tumbling(t["events"], "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).drop("window_end"), "window_start"),
        f"SELECT STRFTIME(TIME_BUCKET(INTERVAL 1 HOUR, ts), '{STAMP}') AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    ),
    "stream_sliding": planned(
        lambda t, s: _stamped(sliding(t["events"], "ts", "2 hours", "1 hour", [], [F.count(F.lit(1)).alias("n")]).drop("window_end"), "window_start"),
        f"SELECT STRFTIME(w, '{STAMP}') AS window_start, COUNT(*) AS n FROM (SELECT UNNEST([TIME_BUCKET(INTERVAL 1 HOUR, ts), TIME_BUCKET(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1",
    ),
    "stream_sessions": planned(
        lambda t, s: _stamped(sessions(t["events"], "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")]).drop("session_end"), "session_start"),
        f"SELECT STRFTIME(MIN(ts), '{STAMP}') AS session_start, user_id, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s "
        "FROM (SELECT user_id, ts, event_id, ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s",
    ),
}
