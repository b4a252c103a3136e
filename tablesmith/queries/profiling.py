"""Column profiles of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import FINGERPRINTS, profile
from . import planned

#: The tables' columns by logical type.
COLUMNS = {
    "region": "r_regionkey:numeric r_name:text",
    "nation": "n_nationkey:numeric n_name:text n_regionkey:numeric",
    "customer": "c_custkey:numeric c_name:text c_nationkey:numeric c_acctbal:numeric c_mktsegment:text",
    "supplier": "s_suppkey:numeric s_name:text s_nationkey:numeric s_acctbal:numeric",
    "part": "p_partkey:numeric p_name:text p_brand:text p_type:text p_size:numeric p_retailprice:numeric",
    "orders": "o_orderkey:numeric o_custkey:numeric o_orderstatus:text o_totalprice:numeric o_orderdate:date o_orderpriority:text",
    "lineitem": "l_orderkey:numeric l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:text l_linestatus:text l_shipdate:date",
    "events": "event_id:numeric ts:date user_id:numeric event_type:text value:numeric props:text",
}
OUT = ["column", "dtype", "null_pct", "distinct_count", "cardinality_ratio", "fingerprint", "is_id", "is_unique", "whole", "numeric_min", "numeric_max", "date_min", "date_max", "avg_len", "role"]


def oracle(table: str) -> str:
    parts = []
    for spec in COLUMNS[table].split():
        c, kind = spec.split(":")
        number = kind == "numeric"
        parts.append(
            f"SELECT '{c}' AS c, '{kind}' AS dtype, COUNT(*) AS n, COUNT({c}) AS filled, COUNT(DISTINCT {c}) AS d, {f'CAST(MIN({c}) AS DOUBLE)' if number else 'NULL'} AS lo, "
            f"{f'CAST(MAX({c}) AS DOUBLE)' if number else 'NULL'} AS hi, {f'ROUND(AVG(LENGTH({c})), 2)' if kind == 'text' else 'NULL'} AS len, "
            f"{f'BOOL_AND({c} = FLOOR({c}))' if number else 'FALSE'} AS whole, {f'CAST(MIN({c}) AS VARCHAR)' if kind == 'date' else 'NULL'} AS first, {f'CAST(MAX({c}) AS VARCHAR)' if kind == 'date' else 'NULL'} AS last FROM {table}"
        )
    named = "REGEXP_MATCHES(c, '(^|_)(id|key|code|no|num)$')"
    uniq = "(filled = n AND d = filled)"
    return (
        f"SELECT c AS \"column\", dtype, ROUND(1 - filled / n, 4) AS null_pct, d AS distinct_count, ROUND(d / filled, 4) AS cardinality_ratio, CASE WHEN whole THEN 'integer' END AS fingerprint, {uniq} AND d > 1 AND {named} AS is_id, {uniq} AS is_unique, whole, first AS date_min, last AS date_max, lo AS numeric_min, hi AS numeric_max, len AS avg_len, "
        f"CASE WHEN dtype = 'date' THEN 'timestamp' WHEN {named} AND ({uniq} AND d > 1 OR dtype <> 'text') THEN 'id' WHEN dtype = 'numeric' THEN 'measure' WHEN d / filled <= 0.7 AND d <= 50 THEN 'dimension' ELSE 'text' END AS role "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


QUERIES = {f"profile_{t}": planned(lambda tables, s, t=t: profile(tables[t], t).select(*OUT), oracle(t)) for t in COLUMNS} | {
    "fingerprint_urls": planned(
        lambda t, s: t["pages"].agg(F.round(F.avg(F.col("url").rlike(FINGERPRINTS["url"]).cast("int")), 4).alias("share")),
        "SELECT ROUND(AVG(CASE WHEN REGEXP_MATCHES(LOWER(url), '^https?://') THEN 1 ELSE 0 END), 4) AS share FROM pages",
    ),
}
