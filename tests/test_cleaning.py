import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesmith.functions.dates import order_votes, parsed_date, voted_order
from tablesmith.functions.numbers import parsed_number
from tablesmith.functions.similarity import common_subsequence, ratio, sorted_tokens
from tablesmith.functions.text import nulled, squeezed
from tablesmith.operators import canonical, dedup, rules
from tablesmith.operators.cleaning import clean
from tablesmith.operators.ledger import ROW_ID


def table(spark, **columns):
    names = list(columns)
    schema = f"{ROW_ID} long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))], schema)


def values(df, column):
    return [r[0] for r in df.orderBy(ROW_ID).select(column).collect()]


NUMBERS = {
    "$1,234.50": 1234.5, "($45.00)": -45.0, "10%": 0.1, "$2.5M": 2.5e6, "$125k": 125e3, "(10%)": -0.1, "1,200": 1200.0, " 987 ": 987.0, "₹5": 5.0, "$-5": -5.0, "-$5": None,
    "1d": None, "5f": None, "1_000": 1000.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "abc": None, "": None, "3b": 3e9, "1,23": None, "inf": float("inf"), "--5": None,
}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", parsed_number(F.col("t")).alias("v")).collect()} == NUMBERS


DATES = [("2026-04-03", None, "2026-04-03"), ("2026-04-03 10:30", None, "2026-04-03"), ("15/04/2026", "dmy", "2026-04-15"), ("04/15/2026", "mdy", "2026-04-15"), ("1/2/25", "dmy", "2025-02-01"), ("01-Jan-2025", None, "2025-01-01"), ("January 5 2025", None, "2025-01-05"), ("Mar 7, 2024", None, "2024-03-07"), ("31/31/2025", "dmy", None), ("May", None, None), ("10", None, None)]


@pytest.mark.parametrize("text, order, expected", DATES)
def test_dates(spark, text, order, expected):
    assert spark.createDataFrame([(text,)], "t string").select(parsed_date(F.col("t"), order)).first()[0] == expected


@pytest.mark.parametrize("cells, order", [(["03/04/2026", "15/04/2026"], "dmy"), (["03/04/2026", "04/15/2026"], "mdy"), (["03/04/2026", "05/06/2026"], None), (["2026-01-01", "2026-01-02", "1/2/2026"], "iso")])
def test_date_order(spark, cells, order):
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    assert voted_order(df.agg(*[v.alias(k) for k, v in order_votes(F.col("t")).items()]).first().asDict()) == order


def test_null_tokens_and_white_space(spark):
    df = spark.createDataFrame([(x,) for x in ["NA", "n/a", " - ", "", "None", "unknown", "x", "a   b "]], "t string")
    got = [r[0] for r in df.select(nulled(squeezed(F.col("t")), ["X"])).collect()]
    assert got == [None] * 7 + ["a b"]


def test_money_table(spark):
    df = table(spark, item=["A", "B", "C"], revenue=["$1,234.50", "987", "($45.00)"], discount=["10%", "5%", "0%"], units=["1,200", "950", "3,400"])
    done = clean(df, "money")
    assert values(done.df, "revenue") == [1234.5, 987.0, -45.0]
    assert values(done.df, "discount") == [0.1, 0.05, 0.0]
    assert values(done.df, "units") == [1200.0, 950.0, 3400.0]
    record = next(r for r in done.ledger.records if r.column == "revenue")
    assert (record.rule, record.cells_affected, record.before[0], record.after[0]) == ("numeric_coerce", 2, "$1,234.50", "1234.5")
    assert {r.rule for r in done.ledger.records if r.column == "discount"} == {"percent_to_fraction"}


def test_clean_table_changes_nothing(spark):
    done = clean(table(spark, id=["1", "2"], product=["a", "b"], price=["1.5", "2.5"]))
    assert done.ledger.total == 0 and not done.flags
    assert dict(done.df.dtypes)["id"] == "bigint" and dict(done.df.dtypes)["price"] == "double"


def test_dates_booleans_and_flags(spark):
    df = table(spark, day=["03/04/2026", "15/04/2026", "07/04/2026"], either=["01/02/2026", "03/04/2026", None], ok=["yes", "N", None], mixed=["1", "2", "x"] , mostly=["1", "2", "3"])
    done = clean(df, "t")
    assert values(done.df, "day") == ["2026-04-03", "2026-04-15", "2026-04-07"]
    assert values(done.df, "ok") == [True, False, None]
    assert [(f.column, f.kind) for f in done.flags] == [("either", "date_order")]
    assert values(done.df, "mixed") == ["1", "2", "x"]
    more = clean(table(spark, x=["1", "2", "3", "n.v."]), "t")
    assert [f.kind for f in more.flags] == ["mixed_type"] and values(more.df, "x")[3] == "n.v."


def test_failed_dates_are_flagged(spark):
    done = clean(table(spark, d=["31/31/2025", "2025-01-01", "x"]), "t", {"d": "date"})
    assert [f.kind for f in done.flags] == ["coerce_failed"]


def test_forced_types_and_tokens(spark):
    done = clean(table(spark, zip=["01", "02"], s=["5", "void"]), "t", {"zip": "text"}, ["void"])
    assert values(done.df, "zip") == ["01", "02"] and values(done.df, "s") == [5, None]


def test_empty_table(spark):
    done = clean(table(spark, a=["x"]).limit(0))
    assert done.df.count() == 0 and done.types == {"a": "text"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["$1,200", "5%", "(3)", " x  y ", "n/a", "yes", "2024-01-02", "03/04/2025", "7k", ""]), min_size=1, max_size=6))
def test_cleaning_is_idempotent(spark, cells):
    once = clean(table(spark, c=cells)).df
    again = clean(once.withColumn("c", F.col("c").cast("string"))).df
    assert values(once.select(ROW_ID, F.col("c").cast("string").alias("c")), "c") == values(again.select(ROW_ID, F.col("c").cast("string").alias("c")), "c")


def test_canonical(spark):
    df = table(spark, country=["USA", "U.S.A.", "America", "United States", "Canada"], status=["Active", "ACTIVE", "active", "gone", "Gone"])
    out, ledger = canonical.canonicalize(df)
    assert values(out, "country") == ["United States"] * 4 + ["Canada"]
    assert values(out, "status") == ["active"] * 3 + ["gone"] * 2
    assert ledger.rules() == {"canonicalize_alias", "canonicalize_case"}
    found = canonical.suggestions(table(spark, c=["Acme Inc", "Acme Inc.", "ACME INC", "Zeta", "usa"]), "c")
    assert {s["kind"] for s in found} == {"alias", "case", "fuzzy"}


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert common_subsequence(a, b) == rows[-1][-1]


def test_ratio(spark):
    assert ratio("", "") == 100 and ratio("abc", "abd") == pytest.approx(66.67, abs=0.01)
    assert spark.createDataFrame([("Inc., ACME  co",)], "t string").select(sorted_tokens(F.col("t"))).first()[0] == "acme co inc"


def test_duplicates(spark):
    df = table(spark, company=["Acme Inc", "Acme Inc.", "Beta LLC", "Gamma", "Delta", "Delta"], amount=["5", "5", "7", "5", "9", "9"])
    done = clean(df).df
    assert [tuple(r) for r in dedup.exact_groups(done).collect()] == [(4, 5, 2)]
    near = dedup.near_duplicates(done).collect()
    assert [(r["row_a"], r["row_b"], r["differs"]) for r in near] == [(0, 1, ["company"])] and near[0]["similarity"] >= 0.85
    assert dedup.near_duplicates(done.select(ROW_ID, "company")).count() == 1
    assert values(dedup.removed(done, [[4, 5], [9], [0, 77]]), "company") == ["Acme Inc", "Acme Inc.", "Beta LLC", "Gamma", "Delta"]
    assert dedup.removed(done, [[4, 5]], "keep").count() == 6


def test_near_duplicates_of_texts_alone(spark):
    names = ["Acme Corporation Ltd", "Ltd Acme Corporation", "Bxrlington Industries", "Burlington Industries", "Zq", "zq.", "Other Words", None]
    df = spark.createDataFrame(list(enumerate(names)), f"{ROW_ID} long, company string")
    want = {(0, 1), (2, 3), (4, 5)}
    assert {(r["row_a"], r["row_b"]) for r in dedup.near_duplicates(df).collect()} == want


def test_rules(spark):
    schema = {"zoo": ["animal", "score"]}
    for bad in (rules.Rule("nope", None, "animal"), rules.Rule("force_type", "x", "animal", "text"), rules.Rule("force_type", None, "none", "text"), rules.Rule("force_type", None, "score", "money"), rules.Rule("null_token", None, "animal", " "), rules.Rule("merge_values", None, "animal", "cat", [])):
        with pytest.raises(rules.RuleError):
            rules.checked([rules.Rule("force_type", None, "score", "text"), bad], schema)
    out, ledger = rules.merged(table(spark, animal=["Cat", "kitty", "dog", None]), "zoo", [rules.Rule("merge_values", None, "animal", "cat", ["CAT", "kitty "])])
    assert values(out, "animal") == ["cat", "cat", "dog", None] and ledger.records[0].cells_affected == 2


def test_near_duplicates_within_one_large_block(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    texts = []
    for _ in range(120):
        t = rng.sample(words, 4)
        texts += [" ".join(t), " ".join(reversed(t)).title() if rng.random() < 0.5 else " ".join(t)[:-1] + "q"]
    df = spark.createDataFrame([(i, 5.0, t, "same") for i, t in enumerate(texts)], f"{ROW_ID} long, strict double, name string, other string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    ordered = lambda t: " ".join(sorted(t.lower().split()))
    ids = sorted(first.values())
    want = {(i, j) for k, j in enumerate(ids) for i in ids[:k] if ratio(ordered(texts[i]), ordered(texts[j])) >= 85}
    assert len(ids) > dedup.BLOCK_ROWS
    assert {(r["row_a"], r["row_b"]) for r in dedup.near_duplicates(df).collect()} == want and len(want) > 100


def test_pairs_of_equal_words_meet_by_their_words(spark):
    names = [f"{a} {b} mill" for a in ("old", "new", "red", "hot") for b in ("ring", "gear", "bolt", "plate", "wheel")]
    texts = [(x, y) for x in [*names, *(" ".join(reversed(n.split())) for n in names), "Old, RING mill!"] for y in ("one", "One.", None)] + [(None, "one"), ("", "one"), ("?", "one"), (None, None), (" old ring mill", "one")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], f"{ROW_ID} long, name string, other string")
    words = lambda t: None if t is None else " ".join(sorted("".join(c if c.isalnum() else " " for c in t.lower()).split()))
    key = [tuple(map(words, t)) for t in texts]
    shown = [tuple(None if x is None else x.strip() for x in t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if key[i] == key[j] and shown[i] != shown[j]}
    got = dedup.near_duplicates(df, alike=100.0).collect()
    assert len(texts) > dedup.BLOCK_ROWS and {(r["row_a"], r["row_b"]) for r in got} == want and {r["similarity"] for r in got} == {1.0}
    keys = dedup.letter_keys(df.withColumn("_s", F.lit("")), ["name", "other"], 100.0)
    assert keys.count() == len(texts) and keys.select("_k").distinct().count() == len(set(key))


def test_fuzzy_pairs_have_no_cap(spark):
    df = spark.createDataFrame([(f"value number {i:04d} of many",) for i in range(3)] + [("Somethng else",), ("something ELSE ",), ("somethingg else",)], "v string")
    got = {(r["a"], r["b"]) for r in canonical.fuzzy_pairs(df, "v").collect()}
    assert ("Somethng else", "something ELSE") in got and len(got) == 6


def test_case_merges_beyond_a_map(spark, monkeypatch):
    rows = [(v, i) for i, v in enumerate(["Ab", "AB", "Ab", "cd", "CD", "x", None, "USA", "usa"])]
    df = spark.createDataFrame(rows, f"v string, {ROW_ID} long")
    plain, ledger = canonical.canonicalize(df, "t", ["v"])
    monkeypatch.setattr(canonical, "MAPPED", 0)
    joined, again = canonical.canonicalize(df, "t", ["v"])
    show = lambda d: [r["v"] for r in d.orderBy(ROW_ID).collect()]
    assert show(plain) == show(joined) == ["Ab", "Ab", "Ab", "cd", "cd", "x", None, "United States", "United States"]
    assert ledger.records == again.records and [r.cells_affected for r in ledger.records] == [2, 2]


def test_votes_extract_nothing_from_cells(spark):
    """Day, month and order are read off by patterns alone, and agree with the numbers that the cells have."""
    from tablesmith.functions.dates import looks_dated, order_votes

    cells = ["13/02/2020", "02/13/2020", "13/13/2020", "0/5/2020", "31.12.99", "12-31-1999", "32/1/2020", "1/2/123", "Jan 5, 2020", "x"]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    votes = df.agg(*[v.alias(k) for k, v in order_votes(F.col("x")).items()], F.collect_list(F.when(looks_dated(F.col("x")), F.col("x"))).alias("dated"))
    assert "regexp_extract" not in votes._jdf.queryExecution().optimizedPlan().toString()
    r = votes.first()
    assert (r.slashed, r.day_first, r.month_first) == (7, 4, 3)
    assert set(r.dated) == {"13/02/2020", "02/13/2020", "31.12.99", "12-31-1999", "Jan 5, 2020"}
