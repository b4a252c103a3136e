"""Operators 1, 7, 8, 9, 10 and the pipeline against brute force."""

import hashlib
import re
import time
from collections import Counter
from fractions import Fraction
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tablesmith.llm import decontamination, edit_embedding, mixing, sharding, simhash
from tablesmith.llm.common import ESTIMATED, FILES_GO, MEASURED, release, stored
from tablesmith.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "zz", s, 0) for i, t, s in rows], SCHEMA)


CLASHES = [f"1 as {c}" for c in ("rank", "key", "fp", "row", "slot", "size", "block", "_rank", "window", "bucket", "tail", "hits", "at")]


def clashing(df):
    return df.selectExpr("*", *CLASHES)


# 1: mixing


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 1}, {"a": 0.9, "b": 0.07, "c": 0.03}])
def test_windows_are_met_and_deviation_is_under_one_block(weights):
    blocks = {"a": 400, "b": 77, "c": 230}
    placed = {}
    for i, p in enumerate(mixing.phases(blocks, weights, 100)):
        done = Counter()
        order = {}
        for s, a in p["shares"].items():
            for k in range(p["took"][s]):
                t = k // a * p["period"] + p["slots"][s][k % a]
                assert mixing.release(k, a, p["period"]) <= t < mixing.deadline(k, a, p["period"])
                assert t not in order
                order[t] = s
                placed[(s, p["before"][s] + k)] = (i, t)
        assert sorted(order) == list(range(p["length"]))
        for t in range(p["length"]):
            done[order[t]] += 1
            for s, a in p["shares"].items():
                assert abs(done[s] - Fraction(a * (t + 1), p["period"])) < 1
    assert len(placed) == sum(blocks.values())


def test_production_mix_keeps_to_the_given_weights():
    weights = mixing.WEIGHTS | {mixing.REST: mixing.OTHER}
    total = sum(Fraction(str(w)) for w in weights.values())
    p = mixing.phases(dict.fromkeys(weights, 5000), weights)[0]
    assert p["period"] == 10268 and p["length"] > 10000
    order = {p["slots"][s][k % a] + k // a * p["period"]: s for s, a in p["shares"].items() for k in range(p["took"][s])}
    done = Counter()
    for t in range(p["length"]):
        done[order[t]] += 1
        assert all(abs(done[s] - Fraction(str(w)) * (t + 1) / total) < 1 for s, w in weights.items())
    assert sum(mixing.exact_shares({"a": 1 / 3, "b": 0.1}).values()) == mixing.LONGEST


def test_schedule_is_earliest_deadline_first():
    a = mixing.shares({"x": 5, "y": 3, "z": 2, "w": 0.4}, 60)
    period, done, want = sum(a.values()), dict.fromkeys(a, 0), {s: [] for s in a}
    for t in range(period):
        ready = [(mixing.deadline(k, a[s], period), s) for s, k in done.items() if k < a[s] and mixing.release(k, a[s], period) <= t]
        _, s = min(ready)
        want[s].append(t)
        done[s] += 1
    assert mixing.one_period(a) == want


def test_mix_is_whole_and_gapless(spark):
    rows = [(i, "t", None if i % 50 == 0 else f"s{i % 3}" if i % 2 else "hot") for i in range(900)] + [(5, "t", "hot"), (None, "n", "new")]
    out = mixing.mix(clashing(table(spark, rows)), {"hot": 0.5, "s0": 0.2, "s1": 0.2, "s2": 0.1}, 0.05, 8, 100).toPandas()
    assert sorted(out.position) == list(range(902)) and set(out.mix_class) == {"hot", "s0", "s1", "s2", "*"}
    assert (out.release <= out.slot).all() and (out.slot < out.deadline).all()
    assert out.groupby("slot").mix_class.nunique().max() == 1 and out.groupby("slot").size().max() == 8
    assert (out.sort_values("position").slot.diff().dropna() >= 0).all()
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_mixed_stage_keeps_rows_and_order(spark, tmp_path):
    rows = [(i, f"text {i}", f"src{i % 4}") for i in range(600)]
    docs = table(spark, rows)
    mixing.stage(spark, docs, "").write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.columns == docs.columns and back.count() == 600
    got = [r.doc_id for r in back.selectExpr("doc_id", "_metadata.file_path f", "_metadata.row_index r").orderBy("f", "r").collect()]
    assert got == [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]


# 7: sharding


def test_best_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = sorted(rng.integers(1, 60, rng.integers(1, 120)).tolist(), reverse=True)
        bins: list[int] = []
        for s in sizes:
            fit = [i for i, left in enumerate(bins) if left >= s]
            if fit:
                bins[min(fit, key=lambda i: (bins[i], i))] -= s
            else:
                bins.append(100 - s)
        runs = sharding.pack(list(Counter(sizes).items()), 100)
        used = Counter()
        for s, b, n in runs:
            used[b] += s * n
        assert sorted(100 - u for u in used.values()) == sorted(bins)


def test_capacity_tree_splits_leaves():
    tree = sharding.CapacityTree()
    rng = np.random.default_rng(0)
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 10**6, 3000))]
    for v in values:
        tree.add(*v)
    assert len(tree.leaves) > 1
    left = sorted(values)
    for want in rng.integers(0, 10**6, 3000).tolist():
        got = tree.take_tightest(want)
        best = next((v for v in left if v[0] >= want), None)
        assert got == best
        if best:
            left.remove(best)


def test_shards(spark):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 700)] + ["copy of one text"] * 900 + [None, "", "é" * 50]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "again", "s"), (None, None, "s")]
    out = sharding.shard_documents(clashing(table(spark, rows)), 8, 16).toPandas()
    assert len(out) == len(rows)
    total = out.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 0.02 * total.mean() + 500
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    text = dict(enumerate(texts))
    whole = out[out.doc_id.map(lambda i: text.get(i, "?")).fillna("") != "copy of one text"]
    assert whole.groupby("text_crc32").shard.nunique().max() == 1
    assert sharding.shard_documents(table(spark, rows).limit(0)).count() == 0
    few = sharding.shard_documents(table(spark, rows[:3]), 40)
    assert few.count() == 3


def test_size_classes_are_bounded(spark):
    sizes = [1, 65535, 65536, 65537, 10**6 + 1, 2**31 - 1, 2**40 + 12345]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(__import__("pyspark.sql.functions", fromlist=["col"]).col("s"))).collect()]
    assert all(s <= g <= s * (1 + 2**-15) for s, g in zip(sizes, got, strict=True)) and got[:3] == sizes[:3]


# 8: SimHash


def brute_print(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(150).collect()]
    long = " ".join(texts)[:6000]
    texts += [long, long + " end", long.replace("the", "tha", 1), None, "", "one", "One two", "ÉA b\x0bc", long.upper()]
    rows = [(i + 7, t, "s") for i, t in enumerate(texts)] + [(7, texts[0], "s"), (None, texts[3], "s")]
    got = simhash.near_duplicates(clashing(table(spark, rows))).toPandas()
    prints = {i: brute_print(t) for i, t, _ in rows if i is not None}
    assert all(int(f) & (1 << 64) - 1 == prints[int(i)] for i, f in zip(got.doc_id, got.fp, strict=True) if i == i)
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] > root[a]:
                    root[b], changed = root[a], True
    assert {int(i): int(c) for i, c in zip(got.doc_id, got.component_id, strict=True) if i == i} == root
    assert len(got) == len(rows)


def test_golay_code():
    words = simhash.codewords()
    assert np.bincount(words).tolist() == [2048] * 4096  # perfect: each codeword has its sphere
    rows, found = simhash.near(np.arange(0, 1 << 23, 997), 23)
    assert set(np.bincount(rows)) == {1, 6}


@pytest.mark.parametrize("spread", range(4))
def test_keys_lose_no_link(spread):
    rng = np.random.default_rng(spread)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) << np.uint64(1)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, spread, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    left, right = simhash.keys(a.view(np.int64), True), simhash.keys(b.view(np.int64), False)
    both = set(zip(*(x.tolist() for x in left), strict=True)) & set(zip(*(x.tolist() for x in right), strict=True))
    assert len({r for r, _ in both}) == 1500


def test_keys_are_not_broadcast(spark):
    """Spark takes the keys of a fingerprint, up to a hundred, for one row."""
    plan = simhash.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def kept_rows(spark, stage, rows, folder=""):
    """(doc_id, text) of the rows that a stage keeps, given columns of clashing names; all of which come back as they were."""
    docs = clashing(table(spark, rows)).selectExpr("*", "'keepme' as _id", "'k' as id", "0 as n", "1L as h", "'x' as _key", "2 as _part")
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    back = out.collect()
    assert all(r["_id"] == "keepme" and r["id"] == "k" and r["_key"] == "x" and r["_part"] == 2 and r["at"] == 1 for r in back)
    return sorted(((r.doc_id, r.text) for r in back), key=str)


def test_dedup_stage(spark):
    other = "other words are here"
    rows = [(4, "a b c d", "s"), (2, "a b c d", "s"), (9, other, "s"), (9, other, "s"), (None, "a b c d", "s"), (None, "just a null", "s"), (None, "just a null", "s"), (1, None, "s"), (3, "", "s")]
    rows += [(2, "one text of id two", "s"), (9, "a b c d", "s"), (5, "one text of id two", "s")]
    want = [(2, "a b c d"), (9, other), (None, "just a null"), (1, None), (2, "one text of id two")]
    assert kept_rows(spark, simhash.stage, rows) == sorted(want, key=str)
    nulls = [(None, t, "s") for t in ("x y z", "x y z", "p q r s", None, "")]
    assert sorted(t or "" for _, t in kept_rows(spark, simhash.stage, nulls)) == ["", "p q r s", "x y z"]
    assert simhash.stage(spark, table(spark, rows).limit(0), "").count() == 0


def test_kept_rows_are_not_broadcast(spark):
    """The rows that stay are most of all rows: an id and a key each, which Spark would send through the driver up to 10 MB of its estimate."""
    out = simhash.stage(spark, table(spark, [(i, f"text {i} of its own", "s") for i in range(50)]), "")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and out.count() == 50


# 9: decontamination


def bench_words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def test_contamination(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", "x9"]
    make = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, make(25)), (2, make(10)), (10, make(4)), (3, "Solo!"), (4, None), (5, "--"), (6, make(12)), (6, make(11))]
    items.append((7, items[0][1].upper().replace(" ", " - ", 3)))
    docs = []
    for i in range(120):
        t = make(int(rng.integers(0, 60)))
        if i % 3 == 0:
            source = bench_words(items[int(rng.integers(0, len(items)))][1])
            a = int(rng.integers(0, 5))
            t = t + " " + ", ".join(w.decode() for w in source[a : a + int(rng.integers(5, 25))]) + "\n" + make(3)
        docs.append((i, t, "s"))
    docs += [(200, None, "s"), (201, "", "s"), (202, "solo", "s"), (202, "solo", "s"), (None, items[1][1], "s")]
    windows = {}
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    want = []
    for i, t, _ in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[x]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h", "2 as row", "3 as size")
    got = [tuple(r) for r in decontamination.contamination(clashing(table(spark, docs)), bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[5] for x in want) > 8
    none = decontamination.contamination(table(spark, docs), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)
    assert decontamination.contamination(table(spark, docs).limit(0), bench).count() == 0


def test_decontamination_stage_decides_by_text(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(1, "clean words only", "s"), (1, f"see {item}", "s"), (None, item, "s"), (None, "clean", "s"), (2, None, "s"), (3, " ".join(item.split()[3:13]), "s"), (3, " ".join(item.split()[3:12]), "s"), (4, "clean words only", "s")]
    want = [(1, "clean words only"), (None, "clean"), (2, None), (3, " ".join(item.split()[3:12])), (4, "clean words only")]
    assert kept_rows(spark, decontamination.stage, rows, f"file://{tmp_path}") == sorted(want, key=str)


def test_items_without_ids_hit_and_do_not_count(spark):
    words = " ".join(f"v{i}" for i in range(12))
    bench = spark.createDataFrame([(None, words), (None, "v1 " + words)], "item_id long, text string")
    got = decontamination.contamination(table(spark, [(1, words, "s"), (2, "v3", "s")]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(12, 0, True), (0, 0, False)]


def test_mixing_and_quality_stages_keep_clashing_columns(spark):
    rows = [(i % 7 if i % 5 else None, None if i % 11 == 0 else f"text {i}", f"src{i % 3}") for i in range(90)]
    assert kept_rows(spark, mixing.stage, rows) == sorted(((i, t) for i, t, _ in rows), key=str)


def test_numbers_are_gapless_for_rows_alike(spark):
    rows = [(None, "same", "src0") for _ in range(3000)] + [(1, "same", "src0")] * 20
    out = mixing.mix(table(spark, rows)).toPandas()
    assert sorted(out.position) == list(range(3020))
    shards = sharding.shard_documents(table(spark, rows), 4, 16).toPandas()
    assert len(shards) == 3020 and all(sorted(x) == list(range(len(x))) for _, x in shards.groupby("shard").slot)


# 10: edit embedding


def plain_walk(text):
    t, out = 0, []
    for c in edit_embedding.classes(np.array([ord(c) for c in text], "<u4")).tolist():
        t += int(edit_embedding.stays()[c, t % edit_embedding.PERIOD])
        out.append(t)
    return out


def test_walks(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc dé")) for _ in range(n)) for n in [0, 1, 5, 300, 40, 2, 0, 77]]
    codes, sizes = edit_embedding.code_points(texts), np.array([len(t) for t in texts])
    for alone in (0, 3, 99):
        monkeypatch.setattr(edit_embedding, "ALONE", alone)
        times = edit_embedding.walk(codes, edit_embedding.spans(sizes), sizes, np.zeros(len(texts), int))
        assert times.tolist() == [t for x in texts for t in plain_walk(x)]


def test_edit_embedding(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefgh é日"), int(n))) for n in rng.integers(0, 400, 60)] + ["", None, "a", "ab", "same text here", "same text here"]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in edit_embedding.fingerprints(clashing(table(spark, rows))).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t, _), (_, n, _) in pairwise([*order, order[0]]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        a, b, c = edit_embedding.written(edit_embedding.embed([t, edited, n]))
        alike = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        assert r.near_edited == pytest.approx(alike(a, b)) and r.near_next == pytest.approx(alike(a, c))
    assert len(got) == len(rows)
    one = edit_embedding.fingerprints(table(spark, [(1, "abcd", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert edit_embedding.fingerprints(table(spark, rows).limit(0)).count() == 0
    odd = [(None, "x", "s"), (None, "y", "s"), (4, "z", "s"), (4, "z", "s")]
    assert edit_embedding.fingerprints(table(spark, odd)).count() == 4


def test_likeness_follows_edits():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 3000))
    scores = []
    for edits in (0, 3, 60, 1500):
        x = list(text)
        for _ in range(edits):
            x[int(rng.integers(0, len(x)))] = str(rng.choice(list("abcdefghij")))
        if edits == 3:
            x.insert(1000, "q")
        a, b = edit_embedding.embed([text, "".join(x)])
        scores.append((a == b).mean())
    assert scores[0] == 1 and scores[1] > 0.9 and scores[1] > scores[2] > scores[3]


def test_similar_documents(spark):
    rng = np.random.default_rng(10)
    base = ["".join(rng.choice(list("abcdefghij klm"), 800)) for _ in range(20)]
    texts = base + [t[:400] + "Q" + t[400:] for t in base] + base[:3] + ["", None]
    big = "".join(rng.choice(list("nopqrstuv wx"), 900))
    for i in range(60):  # one large group of edited copies
        at = int(rng.integers(0, 900))
        texts.append(big[:at] + f"{i:02d}" + big[at:])
    prints = edit_embedding.written(edit_embedding.embed([t or "" for t in texts]))
    df = spark.createDataFrame([*enumerate(prints), (None, prints[0]), (None, "0" * 128)], "doc_id long, fingerprint string")
    got = edit_embedding.similar(df.selectExpr("*", "1 as n", "2 as uid")).collect()
    assert len(got) == len(prints) + 2
    of = {r.doc_id: r.similar_id for r in got if r.doc_id is not None}
    alike = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
    brute = [(i, j) for i in range(len(prints)) for j in range(i) if alike(prints[i], prints[j]) >= 0.8]
    assert sum(of[i] == of[j] for i, j in brute) >= 0.95 * len(brute) > 500
    root = {i: i for i in of}
    for _ in range(len(prints)):
        for i, j in brute:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[c] == root[i] for i, c in of.items())  # no class joins what no chain of links joins
    assert Counter(of[i] for i in range(45, 105)).most_common(1)[0][1] >= 55
    assert edit_embedding.similar(df.limit(0)).count() == 0


def test_similar_documents_of_the_tables(spark, data):
    got = {r.doc_id: r for r in edit_embedding.similar_documents(spark, data).collect()}
    ids = sorted(got)
    packed = np.array([list(bytes.fromhex(got[i].fingerprint)) for i in ids], np.uint8)
    samples = np.concatenate([packed >> 4, packed & 15], 1)
    found = wanted = 0
    for k, i in enumerate(ids):
        for j in np.flatnonzero((samples[:k] == samples[k]).mean(1) >= 0.8).tolist():
            wanted += 1
            found += got[i].similar_id == got[ids[j]].similar_id
    assert found >= 0.9 * wanted > 0


# Pipeline


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == first.columns
            assert docs.exceptAll(before).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    kept = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.read.parquet(str(tmp_path / "1"))).collect()}
    assert all(i == c for i, c in kept.items())
    clean = decontamination.contamination(spark.read.parquet(str(tmp_path / "2")), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert clean.where("contaminated").count() == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rejected = first.join(spark.read.parquet(str(tmp_path / "0")), "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.where("quality = 1").count() <= 0.02 * labels.where("quality = 1").count()
    order = [r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).selectExpr("doc_id", "_metadata.file_path f", "_metadata.row_index r").orderBy("f", "r").collect()]
    assert [r.doc_id for r in docs.orderBy("start").collect()] == order


def test_large_groups_lose_no_pair(spark):
    """40 texts share one key; two pairs are alike, and neither has one of the two texts that stand for the key."""
    texts, twins = [], {}
    for uid in range(40):
        sketch = bytes((uid * 7 + i * (uid + 3)) % 255 + 1 for i in range(256))
        texts.append([uid, bytearray(sketch), 256, [7]])
    df = spark.createDataFrame([(u, k) for u, _, _, k in texts], "uid long, keys array<long>")
    _, stars = simhash.band_links(df)
    ends = {x for r in stars.collect() for x in (r.a, r.b)}
    free = [u for u in range(40) if u not in ends][:4]
    for x, y in (free[:2], free[2:]):
        texts[y][1] = bytearray(texts[x][1])
        texts[y][1][5] ^= 1
        twins[(y, x)] = 1
    before = {(r.u, r.v) for r in simhash.pairs_of(stars).collect()}
    assert not before & twins.keys()
    full = spark.createDataFrame([(u, bytes(s), n) for u, s, n, _ in texts], "uid long, sketch binary, size long")
    part = spark.createDataFrame([], "node long, root long")
    assert {(r.u, r.v) for r in simhash.crowd_pairs(stars, full, part).collect()} == twins.keys()
    # Texts of one class by then are not compared again.
    joined = spark.createDataFrame([(y, x) for y, x in twins], "node long, root long")
    assert simhash.crowd_pairs(stars, full, joined).count() == 0


def test_a_pair_of_many_keys_comes_once():
    sketch = b"\1" * 256
    lists = {1: [7, -4, 9], 2: [9, 7], 3: [7, -4]}  # keys of each text; 1 and 2 meet in 7 and 9, 1 and 3 in -4 and 7, 2 and 3 in 7
    side = [sorted(u for u in lists if k in lists[u]) for k in (-4, 7, 9)]
    row = {"key": pa.array([-4, 7, 9])}
    for s in "xy":
        row |= {f"{s}_uid": pa.array(side), f"{s}_root": pa.array(side), f"{s}_size": pa.array([[256] * len(u) for u in side])}
        row |= {f"{s}_sketch": pa.array([[sketch] * len(u) for u in side], pa.list_(pa.binary())), f"{s}_keys": pa.array([[lists[t] for t in u] for u in side])}
    for batch in (pa.RecordBatch.from_pydict(row), pa.RecordBatch.from_pydict(row).slice(1)):
        pairs = Counter(p for b in simhash.crossed([batch]) for p in zip(*(b.column(c).to_pylist() for c in "uv"), strict=True))
        # Each text is on both sides here, so a pair comes from both.
        assert pairs == ({(2, 1): 2, (3, 1): 2, (3, 2): 2} if batch.num_rows == 3 else {(2, 1): 2, (3, 2): 2})


def test_keys_shared_below_another():
    rng = np.random.default_rng(5)
    x, y = ([rng.integers(-9, 9, rng.integers(0, 6)).tolist() for _ in range(n)] for n in (40, 30))
    of = lambda lists: pa.array([[], *lists], pa.list_(pa.int64()))[1:]
    for key in (-9, -2, 3, 9):
        want = [[any(k < key for k in set(a) & set(b)) for b in y] for a in x]
        assert simhash.share_lesser(of(x), of(y), key).tolist() == want


def test_alike_texts_of_a_large_group(spark):
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    base, texts = list(rng.choice(vocab, 300)), []
    for _ in range(70):  # edits of one text, about as many pairs at 0.8 of the shingles or more as under
        copy = list(base)
        for i in rng.choice(300, rng.integers(1, 14), replace=False):
            copy[i] = str(rng.choice(vocab))
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in simhash.alike_texts(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    sets, prints = [simhash.shingle_set(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    root = list(range(70))
    for i in range(70):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert len(set(root)) > 1
    assert got == dict(enumerate(root))


def test_alike_texts(spark):
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts, truth = [], []
    for k in range(25):
        base = list(rng.choice(vocab, 220))
        for _ in range(4):
            copy = list(base)
            for i in rng.integers(0, len(copy), 2):
                copy[i] = str(rng.choice(vocab))
            texts.append(" ".join(copy))
            truth.append(k)
    texts += [texts[0], "", None, "one two"]
    docs = clashing(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r.doc_id: r.component_id for r in simhash.alike_texts(docs).collect()}
    sets = [simhash.shingle_set(t or "") for t in texts]
    found = wanted = 0
    for i in range(100):
        for j in range(i):
            alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            wanted += alike
            found += alike and got[i] == got[j]
            assert got[i] != got[j] or truth[i] == truth[j]
    assert found >= 0.95 * wanted > 50
    assert got[100] == got[0] and got[101] == got[102] and got[103] == 103 and len(got) == len(texts)
    assert simhash.alike_texts(docs.limit(0)).count() == 0


def test_dedup_stage_drops_lightly_edited_copies(spark):
    rng = np.random.default_rng(5)
    rows, far = [], 0
    for k in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        edited = list(base)
        edited[40], edited[110] = "new", "other"  # 136 of 156 shingles are shared
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(edited), "s")]
        far += (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() > simhash.DISTANCE
    assert far > 10
    assert sorted(r.doc_id for r in simhash.stage(spark, table(spark, rows), "").collect()) == list(range(0, 60, 2))


def test_large_group_of_edited_copies_is_one_class(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(200):
        edited = list(base)
        for j in rng.integers(0, 300, 3):
            edited[j] = f"x{i}"
        rows.append((i, " ".join(edited), "s"))
    assert [r.doc_id for r in simhash.stage(spark, table(spark, rows), "").collect()] == [0]


def test_shuffle_files_go_with_what_is_stored(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p for d in disk.localDirsString() for p in Path(d).glob("*/shuffle_*")}

    before, own = files(), spark.conf.get(FILES_GO)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 7 and spark.conf.get(FILES_GO) == own


def test_estimates_are_not_trusted_in_what_is_stored(spark):
    """Lists of 6 MB that explode into 19 MB aren't broadcast up to 10 MB; a small table is, as it is measured."""
    own = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    lists = stored(spark.range(4000).select(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64("id", i)).alias("keys")))
    keys = lists.select(F.explode("keys").alias("key"))

    def plan(df):
        stored(df)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()

    large = spark.range(5_000_000).select(F.xxhash64("id").alias("key"))
    assert "BroadcastHashJoin" in large.join(keys, "key")._jdf.queryExecution().sparkPlan().toString()  # as Spark would by itself
    assert "BroadcastHashJoin" not in plan(large.join(keys, "key"))
    assert "BroadcastHashJoin" in plan(large.join(keys.limit(9), "key"))
    assert {k: spark.conf.get(k, None) for k in own} == own


def test_release(spark):
    kept = stored(spark.range(5))
    assert kept.count() == 5 and release(spark) > 0 and release(spark) == 0
