"""Every query that has SQL for DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tablesmith.queries import Tables, every, linking

QUERIES = every()


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v.normalize()) if hasattr(v, "normalize") and not isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in Tables.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [k for k, q in QUERIES.items() if q.oracle])
def test_oracle(spark, data, duck, name):
    df = QUERIES[name].run(spark, data)
    cols = sorted(df.columns)
    found = duck.execute(QUERIES[name].oracle)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    ours = sorted(str([shown(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(str([shown(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert ours == theirs


def test_containment_by_compared_values(spark, data, tmp_path):
    """Keys beyond 2**53 are compared as doubles, so such a column may not be unique; columns that the SQL doesn't name don't count."""
    con = duckdb.connect()
    change = {"customer": "SELECT * REPLACE (c_custkey + 9007199254740992 AS c_custkey) FROM", "orders": "SELECT *, 1 AS copy FROM"}
    for t in linking.KEYS:
        con.execute(f"COPY ({change.get(t, 'FROM')} '{data}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    q = QUERIES["link_containment"]
    found = con.execute(q.oracle)
    names = [d[0] for d in found.description]
    assert {tuple(r[c] for c in names) for r in q.run(spark, str(tmp_path)).collect()} == set(found.fetchall())


def test_containment_as_printed(spark, data, tmp_path):
    """The SQL compares numbers as printed: -0.0 (a balance that rounds to nothing) is not the key 0, and a column with both is unique."""
    con = duckdb.connect()
    change = {
        "customer": "SELECT * REPLACE (CASE c_custkey WHEN 3 THEN -0.0::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM",
        "supplier": "SELECT * REPLACE (CASE s_suppkey WHEN 3 THEN -0.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal) FROM",
    }
    for t in linking.KEYS:
        con.execute(f"COPY ({change.get(t, 'FROM')} '{data}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    q = QUERIES["link_containment"]
    found = con.execute(q.oracle)
    names = [d[0] for d in found.description]
    theirs = set(found.fetchall())
    assert {tuple(r[c] for c in names) for r in q.run(spark, str(tmp_path)).collect()} == theirs
    assert ("customer", "c_acctbal", "supplier", "s_acctbal", 1) in theirs


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "sum_o_totalprice"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, data):
    plan = QUERIES["filter_predicates"].run(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_quantity" in plan.split("PushedFilters")[1] and "l_extendedprice" not in plan


def test_no_sketch_for_each_value(spark, data):
    df = QUERIES["agg_approx_distinct"].run(spark, data)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    sketches = [x for x in plan.splitlines() if "approx_count_distinct" in x and "Aggregate" in x]
    assert sketches and all("keys=[]" in x for x in sketches)
    assert df.first().close is True
