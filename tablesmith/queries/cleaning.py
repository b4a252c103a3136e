"""Cleaning operators on real columns: rendered as messy text within the query, and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.booleans import parsed_boolean
from ..functions.dates import order_votes, parsed_date, voted_order
from ..functions.numbers import parsed_number, with_numbers
from ..functions.text import nulled, squeezed
from ..operators import canonical, dedup, rules
from ..operators.cleaning import clean
from ..operators.ledger import ROW_ID
from ..sources import text
from ..sources.json_ import flattened
from ..workers import scratch
from . import Query, Tables, planned


def _currency(t, spark):
    shown = t["orders"].select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("shown"))
    return with_numbers(shown, {"shown": "value"}).select("o_orderkey", "value")


def _dates(pattern):
    def build(t, spark):
        shown = t["orders"].select(F.date_format("o_orderdate", pattern).alias("shown"))
        order = voted_order(shown.agg(*[v.alias(k) for k, v in order_votes(F.col("shown")).items()]).first().asDict())
        return shown.groupBy(parsed_date(F.col("shown"), order).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("voted", F.lit(order))

    return build


def _parens(t, spark):
    shown = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("("), F.format_number(F.abs("s_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("s_acctbal", 2))
    return t["supplier"].select("s_suppkey", parsed_number(shown).alias("value"))


def _cased(t, spark):
    k = F.col("c_custkey") % 3
    shown = F.when(k == 0, F.upper("c_mktsegment")).when(k == 1, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.initcap("c_mktsegment")))
    merged = canonical.case_merged(t["customer"].select(shown.alias("segment")), "segment")
    return merged.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def _aliases(t, spark):
    k = F.col("n_nationkey") % 4
    shown = F.when(k == 0, F.lit("U.S.A.")).when(k == 1, F.lit(" uk ")).when(k == 2, F.lit("America")).otherwise(F.col("n_name"))
    return t["nation"].select("n_nationkey", shown.alias("country")).select("n_nationkey", canonical.aliased("country").alias("country"))


def _merged(t, spark):
    out, _ = rules.merged(t["lineitem"].select("l_returnflag"), "lineitem", [rules.Rule("merge_values", None, "l_returnflag", "returned", ["a", " R "])])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def messy(t):
    """Orders as a person's sheet might have them."""
    price = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return t["orders"].select(
        F.col("o_orderkey").alias(ROW_ID),
        F.col("o_orderkey").cast("string").alias("order_no"),
        price.alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("NO").alias("finished"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"))).alias("priority"),
    )


def _typed(t, spark):
    return clean(messy(t), "orders", with_ledger=False).df.drop(ROW_ID)


def _ledger(t, spark):
    return clean(messy(t), "orders").ledger.to_df(spark).select("column", "rule", "cells_affected")


def _resolved(t, spark):
    df = t["nation"].select(F.col("n_nationkey").cast("long").alias(ROW_ID), "n_name")
    return dedup.removed(df, [[0, 5, 7], [3, 4], [9]]).withColumnRenamed(ROW_ID, "row_id")


def _near(t, spark):
    rows = t["customer"].select(
        F.col("c_custkey").alias(ROW_ID),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_mktsegment"), F.lit(" company inc."))).otherwise(F.concat(F.lit("Company, "), F.col("c_mktsegment"), F.lit(" inc"))).alias("name"),
        F.floor(F.col("c_custkey") / 2).alias("pair"),
    )
    return dedup.near_duplicates(rows).select("row_a", "row_b", "similarity", F.array_join("differs", ",").alias("differs"))


def _near_names(t, spark):
    """No strict columns: names with their words in another order, and with a letter more."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.translate(F.lower("p_brand"), "#0123456789", "mabcdefghij"))
    named = t["part"].select(name.alias("name")).distinct()
    turned = named.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"))
    rows = named.unionByName(turned).select(F.xxhash64("name").alias(ROW_ID), "name")
    near = dedup.near_duplicates(rows, alike=100.0)  # what the filter below keeps
    pairs = near.join(rows.select(F.col(ROW_ID).alias("row_a"), F.col("name").alias("a")), "row_a").join(rows.select(F.col(ROW_ID).alias("row_b"), F.col("name").alias("b")), "row_b")
    return pairs.where("similarity = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _scanned(spark, folder):
    """Customers as a large file: a banner, a header, a blank column, rows over several splits, a footer; scanned back."""
    path = f"{scratch(spark)}/files/{uuid.uuid4().hex}"
    rows = Tables(spark, folder)["customer"].select(F.col("c_custkey").alias("k"), F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit(', Inc"')), F.lit(""), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("value"))
    ends = spark.createDataFrame([(-2, "Customers of the year,,,"), (-1, "Customer No,Full Name,,Balance"), (1 << 62, "Total,,,9")], "k long, value string")
    rows.unionByName(ends).repartitionByRange(5, "k").sortWithinPartitions("k").select("value").write.text(path)
    out = text.scan(spark, path)
    return out.select(F.col(ROW_ID).alias("row_id"), *[c for c in out.columns if c != ROW_ID])


def _pairs(t, spark):
    """Names misspelt in case and by a letter: all pairs that are alike, without a cap."""
    shown = t["customer"].select(F.concat(F.lit("section "), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("s")))).alias("segment"))
    return canonical.fuzzy_pairs(shown, "segment").select(F.least(F.lower("a"), F.lower("b")).alias("a"), F.greatest(F.lower("a"), F.lower("b")).alias("b"))


DAYS = "SELECT STRFTIME(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS n, '{}' AS voted FROM orders GROUP BY 1"
CENTS = "CAST(CAST({} AS DECIMAL(18,2)) AS DOUBLE)"

QUERIES = {
    "source_csv_scan": Query(
        _scanned,
        "SELECT ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS row_id, CAST(c_custkey AS VARCHAR) AS customer_no, c_name || ', Inc' AS full_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance FROM customer",
    ),
    "canonical_fuzzy_pairs": planned(
        _pairs,
        "SELECT DISTINCT 'section ' || LOWER(c_mktsegment) AS a, 'section ' || LOWER(c_mktsegment) || 's' AS b FROM customer",
    ),
    "clean_whitespace": planned(
        lambda t, s: t["documents"].select("doc_id", F.length(squeezed(F.col("text"))).cast("long").alias("n")),
        "SELECT doc_id, CAST(LENGTH(TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g'))) AS BIGINT) AS n FROM documents",
    ),
    "clean_null_tokens": planned(
        lambda t, s: t["orders"].groupBy(nulled(F.col("o_orderpriority"), ["5-low"]).alias("priority")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "clean_currency": planned(_currency, f"SELECT o_orderkey, {CENTS.format('o_totalprice')} AS value FROM orders"),
    "clean_percent": planned(
        lambda t, s: t["lineitem"].groupBy(parsed_number(F.concat((F.col("l_discount") * 100).cast("decimal(5,0)").cast("string"), F.lit("%"))).alias("discount")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CAST(CAST(l_discount AS DECIMAL(5,2)) AS DOUBLE) AS discount, COUNT(*) AS n FROM lineitem GROUP BY 1",
    ),
    "clean_parentheses": planned(_parens, f"SELECT s_suppkey, {CENTS.format('s_acctbal')} AS value FROM supplier"),
    "clean_units": planned(
        lambda t, s: t["part"].select("p_partkey", parsed_number(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "k").otherwise("M"))).alias("value")),
        "SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1000000 END AS value FROM part",
    ),
    "clean_booleans": planned(
        lambda t, s: t["labels"].groupBy(parsed_boolean(F.when(F.col("quality") == 1, " Yes").otherwise("f")).alias("good")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT quality = 1 AS good, COUNT(*) AS n FROM labels GROUP BY 1",
    ),
    "clean_dates_day_first": planned(_dates("dd/MM/yyyy"), DAYS.format("dmy")),
    "clean_dates_month_first": planned(_dates("M/d/yyyy"), DAYS.format("mdy")),
    "clean_dates_named": planned(
        lambda t, s: t["orders"].groupBy(parsed_date(F.date_format("o_orderdate", "d MMM yyyy")).alias("day")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT STRFTIME(o_orderdate, '%Y-%m-%d') AS day, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "clean_table": planned(
        _typed,
        "SELECT o_orderkey AS order_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS price, STRFTIME(o_orderdate, '%Y-%m-%d') AS day, "
        "o_orderstatus = 'F' AS finished, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders",
    ),
    "clean_ledger": planned(
        _ledger,
        "SELECT 'price' AS \"column\", 'numeric_coerce' AS rule, COUNT(*) AS cells_affected FROM orders UNION ALL SELECT 'day', 'date_normalize', COUNT(*) FROM orders "
        "UNION ALL SELECT 'finished', 'bool_normalize', COUNT(*) FROM orders UNION ALL SELECT 'priority', 'whitespace_trim', COUNT(*) FROM orders "
        "UNION ALL SELECT 'priority', 'null_normalize', COUNT(*) FROM orders WHERE o_orderkey % 7 = 0",
    ),
    "canonical_case": planned(
        _cased,
        "WITH s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN UPPER(c_mktsegment) WHEN c_custkey % 3 = 1 THEN LOWER(c_mktsegment) ELSE ' ' || UPPER(c_mktsegment[1]) || LOWER(c_mktsegment[2:]) END AS v FROM customer), "
        "c AS (SELECT LOWER(TRIM(v)) AS f, v, COUNT(*) AS n FROM s GROUP BY ALL), l AS (SELECT f, v FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY f ORDER BY n DESC, v DESC) = 1) "
        "SELECT l.v AS segment, CAST(SUM(c.n) AS BIGINT) AS n FROM c JOIN l USING (f) GROUP BY l.v",
    ),
    "canonical_aliases": planned(
        _aliases,
        "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'United States' ELSE n_name END AS country FROM nation",
    ),
    "rule_merge_values": planned(_merged, "SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'returned' ELSE l_returnflag END AS l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1"),
    "dedup_exact_documents": planned(
        lambda t, s: dedup.exact_groups(t["documents"].select(F.col("doc_id").alias(ROW_ID), "text")),
        "SELECT MIN(doc_id) AS first, MAX(doc_id) AS last, COUNT(*) AS n FROM documents GROUP BY text HAVING COUNT(*) > 1",
    ),
    "dedup_lineitem_key": planned(
        lambda t, s: t["lineitem"].dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber"),
        "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem",
    ),
    "dedup_resolve": planned(
        _resolved,
        "SELECT n_name, ROW_NUMBER() OVER (ORDER BY n_nationkey) - 1 AS row_id FROM nation WHERE n_nationkey NOT IN (5, 7, 4)",
    ),
    "dedup_near_rows": planned(
        _near,
        "SELECT a.c_custkey AS row_a, b.c_custkey AS row_b, CAST(1 AS DOUBLE) AS similarity, 'name' AS differs FROM customer a JOIN customer b ON a.c_custkey // 2 = b.c_custkey // 2 AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment",
    ),
    "dedup_near_names": planned(
        _near_names,
        "WITH n AS (SELECT DISTINCT p_name || ' ' || LOWER(p_type) || ' ' || TRANSLATE(LOWER(p_brand), '#0123456789', 'mabcdefghij') AS name FROM part), "
        "r AS (SELECT name FROM n UNION ALL SELECT ARRAY_TO_STRING(LIST_REVERSE(STRING_SPLIT(name, ' ')), ' ') FROM n), "
        "k AS (SELECT DISTINCT name, ARRAY_TO_STRING(LIST_SORT(STRING_SPLIT(name, ' ')), ' ') AS s FROM r) "
        "SELECT a.name AS a, b.name AS b FROM k a JOIN k b USING (s) WHERE a.name < b.name",
    ),
    "dedup_exact_members": planned(
        lambda t, s: dedup.exact_members(t["documents"].select(F.col("doc_id").alias(ROW_ID), "text")),
        "SELECT doc_id AS row_id, MIN(doc_id) OVER (PARTITION BY text) AS first FROM documents QUALIFY COUNT(*) OVER (PARTITION BY text) > 1",
    ),
    "source_json_flatten": planned(
        lambda t, s: flattened(t["events"].select("event_id", F.from_json("props", "k long").alias("props"))),
        "SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS props_k FROM events",
    ),
}
