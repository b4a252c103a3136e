"""Relational algebra: projections, joins, aggregates, set operations, subqueries, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.shaping import chart_pivot
from . import planned, same, spelled

MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
REVENUE = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)"
TOTAL = MONEY.format("o_totalprice")


def _approx_distinct(t, spark):
    """Sketch and exact count apart: in one aggregate, Spark keeps a sketch for each distinct value."""
    keys = t["orders"].select("o_custkey")
    about, exact = keys.agg(F.approx_count_distinct("o_custkey", 0.02).alias("about")), keys.agg(F.count_distinct("o_custkey").alias("n"))
    return about.crossJoin(exact).select(F.expr("ABS(about - n) <= 0.1 * n").alias("close"))


QUERIES = {
    "project_expressions": same(
        "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS tag, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS twice, o_totalprice > 1000 AS large FROM {orders}"
    ),
    "filter_predicates": same(
        "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O' "
        "AND l_discount IS NOT NULL AND NOT (l_tax > 0.06) AND l_shipdate >= TIMESTAMP '1994-01-01'"
    ),
    "filter_like": same("SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' OR p_name LIKE '%1_'"),
    "case_when_buckets": same(
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, COUNT(*) AS n FROM {part} GROUP BY 1"
    ),
    "join_inner": same(f"SELECT c_mktsegment, COUNT(*) AS n, {TOTAL} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_star_3": same(
        f"SELECT p_brand, s_nationkey, {REVENUE} AS revenue FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey "
        "WHERE p_size > 25 GROUP BY p_brand, s_nationkey"
    ),
    "join_chain_5": same(
        f"SELECT r_name, n_name, {REVENUE} AS revenue FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey "
        "JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name"
    ),
    "join_left": same("SELECT c_custkey, COUNT(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey"),
    "join_right": same("SELECT n_name, COUNT(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name"),
    "join_full": same(
        "SELECT COALESCE(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY 1) a "
        "FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM {supplier} WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k"
    ),
    "join_semi": same("SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "join_anti": same("SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)"),
    "join_theta": same("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey"),
    "join_self": same("SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_using": same(
        "SELECT k, x.n AS customers, y.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM {customer} GROUP BY 1) x "
        "JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM {supplier} GROUP BY 1) y USING (k)"
    ),
    "agg_pricing_summary": same(
        f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS sum_qty, {MONEY.format('l_extendedprice')} AS sum_base, {REVENUE} AS sum_disc, COUNT(*) AS n, "
        "MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
    ),
    "agg_count_nulls": same("SELECT COUNT(*) AS n, COUNT(quality) AS filled, COUNT(DISTINCT source) AS sources FROM {documents} LEFT JOIN {labels} USING (doc_id)"),
    "agg_having": same("SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "agg_count_distinct": same("SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderpriority"),
    "agg_filter_clause": same("SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) AS n FROM {events} GROUP BY ALL"),
    "agg_rollup": same("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "agg_cube": same("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "agg_grouping_sets": same("SELECT p_brand, p_size, COUNT(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())"),
    "agg_median": same("SELECT c_mktsegment, ROUND(MEDIAN(c_acctbal), 4) AS mid FROM {customer} GROUP BY c_mktsegment"),
    "agg_percentile": spelled(
        "SELECT o_orderstatus, ROUND(PERCENTILE(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderstatus",
        "SELECT o_orderstatus, ROUND(QUANTILE_CONT(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderstatus",
    ),
    "agg_spread": same("SELECT event_type, ROUND(STDDEV_SAMP(value), 6) AS sd, ROUND(VAR_POP(value), 4) AS var, ROUND(CORR(value, user_id), 6) AS corr FROM {events} GROUP BY event_type"),
    "agg_max_by": same("SELECT p_brand, MAX_BY(p_partkey, p_partkey * 7 % 1009 * 100000 + p_partkey) AS pick FROM {part} GROUP BY p_brand"),
    "agg_string_agg": spelled(
        "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
        "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    ),
    "agg_bools": same("SELECT l_returnflag, BOOL_AND(l_quantity > 0) AS positive, BOOL_OR(l_discount > 0.09) AS deep, CAST(COUNT_IF(l_tax = 0) AS BIGINT) AS untaxed FROM {lineitem} GROUP BY l_returnflag"),
    "agg_approx_distinct": planned(
        _approx_distinct,
        "SELECT COUNT(*) > 0 AS close FROM orders",
    ),
    "agg_share": same("SELECT CAST(ROUND(100.0 * COUNT_IF(event_type = 'click') / COUNT(*), 2) AS DOUBLE) AS share FROM {events}"),
    "set_union": same("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}"),
    "set_union_all": same("SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}) GROUP BY k"),
    "set_intersect": same("SELECT p_partkey AS k FROM {part} INTERSECT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 49"),
    "set_except": same("SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders}"),
    "sort_limit_offset": same("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10"),
    "distinct_rows": same("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}"),
    "cte_twice": same(
        "WITH per AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT MAX(n) AS most FROM per) "
        "SELECT per.o_custkey, per.n FROM per JOIN top ON per.n = top.most"
    ),
    "cte_recursive": same("WITH RECURSIVE r AS (SELECT 1 AS i, CAST(1 AS BIGINT) AS f UNION ALL SELECT i + 1, f * (i + 1) FROM r WHERE i < 12) SELECT i, f FROM r"),
    "subquery_scalar": same("SELECT s_suppkey, s_acctbal FROM {supplier} WHERE s_acctbal > (SELECT AVG(c_acctbal) FROM {customer})"),
    "subquery_correlated": same("SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)"),
    "subquery_in": same("SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.09 AND l_quantity > 45)"),
    "pivot_status": planned(
        lambda t, s: t["orders"].groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0),
        "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    ),
    "chart_pivot_events": planned(
        lambda t, s: chart_pivot(t["events"].select("event_type", (F.col("user_id") % 2).cast("string").alias("half"), F.lit(1).cast("long").alias("one")), "event_type", "half", "one"),
        "SELECT event_type, CAST(SUM(CASE WHEN user_id % 2 = 0 THEN 1 END) AS BIGINT) AS \"0\", CAST(SUM(CASE WHEN user_id % 2 = 1 THEN 1 END) AS BIGINT) AS \"1\" FROM events GROUP BY 1",
    ),
    "unpivot_measures": planned(
        lambda t, s: t["lineitem"].groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")).unpivot("l_returnflag", ["low", "high"], "what", "value"),
        "SELECT l_returnflag, 'low' AS what, MIN(l_quantity) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'high', MAX(l_quantity) FROM lineitem GROUP BY 1",
    ),
    "functions_string": spelled(
        "SELECT p_partkey, UPPER(p_name) AS u, SUBSTRING(p_name, 2, 3) AS s, LENGTH(p_type) AS l, REGEXP_EXTRACT(p_brand, '([0-9]+)', 1) AS d, INSTR(p_name, 'a') AS i, "
        "LPAD(CAST(p_size AS STRING), 4, '0') AS z, REVERSE(p_brand) AS r, SPLIT_PART(p_name, ' ', 1) AS w, MD5(p_name) AS h FROM {part}",
        "SELECT p_partkey, UPPER(p_name) AS u, SUBSTRING(p_name, 2, 3) AS s, CAST(LENGTH(p_type) AS INTEGER) AS l, REGEXP_EXTRACT(p_brand, '([0-9]+)', 1) AS d, CAST(STRPOS(p_name, 'a') AS INTEGER) AS i, "
        "LPAD(CAST(p_size AS VARCHAR), 4, '0') AS z, REVERSE(p_brand) AS r, SPLIT_PART(p_name, ' ', 1) AS w, MD5(p_name) AS h FROM {part}",
    ),
    "functions_date": spelled(
        "SELECT o_orderkey, DATE_FORMAT(o_orderdate, 'yyyy-MM-dd') AS day, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, DATE_FORMAT(DATE_TRUNC('month', o_orderdate), 'yyyy-MM-dd') AS m, "
        "DATEDIFF(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days, DAYOFWEEK(o_orderdate) - 1 AS dow FROM {orders}",
        "SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m-%d') AS day, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(QUARTER(o_orderdate) AS INTEGER) AS q, STRFTIME(DATE_TRUNC('month', o_orderdate), '%Y-%m-%d') AS m, "
        "CAST(DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days, CAST(EXTRACT(dow FROM o_orderdate) AS INTEGER) AS dow FROM {orders}",
    ),
    "functions_math": spelled(
        "SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_quantity), 6) AS root, FLOOR(l_extendedprice) AS low, CAST(l_quantity AS INT) % 7 AS rest, CAST(l_quantity AS INT) DIV 7 AS whole, GREATEST(l_discount, l_tax) AS top, "
        "SIGN(l_discount - l_tax) AS sign, TRY_DIVIDE(l_quantity, l_discount) AS ratio FROM {lineitem}",
        "SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_quantity), 6) AS root, CAST(FLOOR(l_extendedprice) AS BIGINT) AS low, CAST(l_quantity AS INT) % 7 AS rest, CAST(CAST(l_quantity AS INT) // 7 AS BIGINT) AS whole, GREATEST(l_discount, l_tax) AS top, "
        "CAST(SIGN(l_discount - l_tax) AS DOUBLE) AS sign, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS ratio FROM {lineitem}",
    ),
    "functions_json": spelled(
        "SELECT event_type, SUM(CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT)) AS k FROM {events} GROUP BY event_type",
        "SELECT event_type, CAST(SUM(CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM {events} GROUP BY event_type",
    ),
    "functions_array": spelled(
        "SELECT vec_id, SIZE(embedding) AS dims, ROUND(AGGREGATE(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)), 4) AS total FROM {embeddings}",
        "SELECT vec_id, CAST(LEN(embedding) AS INTEGER) AS dims, ROUND(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM {embeddings}",
    ),
    "explode_words": spelled(
        "SELECT word, COUNT(*) AS n FROM (SELECT EXPLODE(SPLIT(text, ' ')) AS word FROM {benchmark}) GROUP BY word HAVING COUNT(*) > 5",
        "SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(STRING_SPLIT(text, ' ')) AS word FROM {benchmark}) GROUP BY word HAVING COUNT(*) > 5",
    ),
    "conversation_turns": same("SELECT conv_id, COUNT(*) AS turns, COUNT(DISTINCT role) AS roles, CAST(MAX(LENGTH(text)) AS BIGINT) AS longest FROM {conversations} GROUP BY conv_id"),
}
