"""Operators 2, 3, 4, 5, 6 against the libraries, a hand-made page, and held-out rows."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest

from tablesmith.llm import html_extraction, layouts, pretokens, quality, token_counts, token_files, toxicity, word_bytes
from tablesmith.llm.decontamination import Words
from tablesmith.llm.html_nodes import Page, blocks, features

ODD = ["it's <|endoftext|> so", "''s 'LL don't", "a\x85b\xa0c", "×÷ªµº²³¹¼½¾", "日本語 ﬁ", "", "   ", "x" * 5000, "!" * 70, "İx é", "🙂 a", "\x1c\x1d", "<|startoftext|>", None]


def documents(spark, texts, extra=False):
    rows = [(i, t, "zz", "s", 1) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "'x' as score", "1 as key", "2 as fp", "'r' as row") if extra else df


@pytest.fixture(scope="module")
def texts(spark, data):
    return [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(120).collect()] + ODD


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_characters_split_as_the_library_does(name):
    t = pretokens.tokenizer(pretokens.vocabulary(name))
    split = pretokens.BYTE_SPLIT if name.startswith("byte") else pretokens.WORD_SPLIT
    for c in pretokens._PLAIN:
        for s in (c, f"a{c}b", f"1{c}1", f" {c} x", f"!{c}!", f"a{c}{c} b", f"{c}\n"):
            low = t.normalizer.normalize_str(s) if t.normalizer else s
            want = [low[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(low)]
            assert split.findall(s.lower() if t.normalizer else s) == want, repr(s)


def test_word_bytes_fuzz():
    rng, chars = np.random.default_rng(0), pretokens._PLAIN
    path = pretokens.vocabulary("word_bpe_49k.json")
    texts = ["".join(chars[i] if rng.random() < 0.5 else "abc 'stm.drelv1 "[i % 16] for i in rng.integers(0, len(chars), rng.integers(0, 60))) for _ in range(1500)]
    want = [e.ids for e in pretokens.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_files.encode_batch(texts, path)] == want
    small = word_bytes.WordIds(50)
    tokens = lambda w: list(w)
    for i in range(0, 300, 10):
        for got, t in zip(small.encode([x.lower().encode() for x in texts[i : i + 10]], tokens), texts[i : i + 10], strict=True):
            assert got is None or bytes(got.tolist()) == "".join(pretokens.WORD_SPLIT.findall(t.lower())).encode()


def test_long_words_are_not_remembered_by_their_first_bytes():
    known = word_bytes.WordIds(100)
    ids = lambda word: [len(word), word[0]]
    for run in (b"-", b"x"):
        one, both = known.encode([run * 40, run * 32], ids)
        assert one is None and both.tolist() == [32, run[0]]
        assert known.encode([run * 32 + b" a " + run * 40, run * 32], ids)[1].tolist() == [32, run[0]]
        later = word_bytes.WordIds(100)
        assert later.encode([run * 70], ids) == [None] and later.encode([run * 32], ids)[0].tolist() == [32, run[0]]


def test_token_counts(spark, texts):
    t = pretokens.tokenizer(pretokens.vocabulary("byte_bpe_50k.json"))
    for extra in (False, True):
        df = documents(spark, texts, extra)
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df.unionByName(df.where("doc_id = 3"))).collect()}
        assert got == {i: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in enumerate(texts)}
    assert token_counts.count_tokens(documents(spark, ["a"]).limit(0)).count() == 0
    assert token_counts.count_tokens(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).count() == 2


def test_a_word_beyond_one_entry(spark):
    text = " zqx" * (token_counts.MOST + 7)
    assert token_counts.count_tokens(documents(spark, [text])).first().n_tokens == len(pretokens.tokenizer(pretokens.vocabulary("byte_bpe_50k.json")).encode(text).ids)


def test_token_files(spark, texts):
    t = pretokens.tokenizer(pretokens.vocabulary("word_bpe_49k.json"))
    files = token_files.write_tokens(documents(spark, texts, True))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_index(files).collect()}
    want, at = {}, 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert token_files.lookup(files, [7]).first().ids == [*t.encode(texts[7], add_special_tokens=False).ids, 2]
    assert "PushedFilters: [In(doc_id" in token_files.lookup(files, [7, 9])._jdf.queryExecution().executedPlan().toString()
    assert token_files.token_index(token_files.write_tokens(documents(spark, ["a"]).limit(0))).count() == 0
    twice = token_files.token_index(token_files.write_tokens(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string"))).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in twice] == [(None, 0), (1, 2), (1, 4)]


def test_tokens_are_made_of_small_pieces(monkeypatch):
    texts = ["é語 " * 50_000, None, "", "x" * (2 << 20), *["word " * 60_000] * 12, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["before", *(x or "" for x in texts)])], ["doc_id", "text"]).slice(1)
    sizes: list[list[int]] = []
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    monkeypatch.setattr(token_files, "encode_batch", lambda some, path: sizes.append([len(x.encode()) for x in some]) or [np.array([len(x)], "<u4") for x in some])
    out = pa.Table.from_batches(token_files.encoded(iter([batch]), "", 2)).to_pydict()
    assert all(sum(x) <= 1 << 20 or len(x) == 1 for x in sizes) and len(sizes) > 4
    assert out["doc_id"] == [*range(1, len(texts) + 1)] and out["at"] == [*range(len(texts))]
    assert out["ids"] == [[len(x or ""), 2] for x in texts]


def test_bloom_filters_are_in_the_files(spark, texts):
    files = token_files.write_tokens(documents(spark, texts))
    jvm, path = spark._jvm, next(f for f in files.inputFiles() if f.endswith(".orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0)) if reader.getNumberOfRows() else None
    kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


PAGE = """<html><head><title>T</title><script>x("</p>")</script></head><body><header class="site-header"><a href="/">Home page</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to serve you.</p><button>Ok</button></div>
<div id="content"><article><h1>Caf&eacute;  title</h1><p>First &amp; <b>bold</b>text,
 more.<br>next line.<p>Second paragraph without an end<ul><li>point one<li>point two</ul><div class="ad">Buy now, cheap!</div></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I like this very much, thank you for it.</p></div></div></div>
<aside class="sidebar"><p>Related stories</p></aside><form><label>Mail</label><input></form><footer>&copy; 2024 Someone</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "e", ""), (4, "p", "plain text only"), (None, "m", "<div><p>a</div>")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_extraction.extract(df.selectExpr("*", "1 as text", "2 as n_chars")).collect()}
    want = "Café title\nFirst & boldtext, more. next line.\nSecond paragraph without an end\npoint one\npoint two"
    assert rows[1].text == want and rows[1].n_chars == len(want) and rows[1].url == "u"
    assert rows[2].text == "" and rows[3].n_chars == 0 and len(rows) == 5


@pytest.mark.parametrize("tag", ["svg-icon", "select-menu", "title-bar", "template-x", "object-viewer", "iframe-embed", "script-runner"])
def test_custom_elements_end_with_their_own_tag(tag):
    page = Page(f"<article><p>before</p><{tag} class=x>inside</{tag}><p>after</p></article><p>rest")
    assert blocks(page, np.ones(len(page.tags), bool)) == "before\ninside\nafter\nrest" and tag in page.tags


@pytest.mark.parametrize("tag", ["select", "object", "math", "svg", "template"])
def test_elements_left_open_lose_nothing(tag):
    page = Page(f"<article><p>before <{tag}><b>x</b> <p>after</p></article><p>rest")
    assert blocks(page, np.ones(len(page.tags), bool)).split() == ["before", "x", "after", "rest"]
    page = Page("<p>a<script>b</p><p>c")
    assert blocks(page, np.ones(len(page.tags), bool)) == "a"


def test_trees_hold_on_unseen_layouts():
    model = html_extraction.trained()
    made = [layouts.generated(np.random.default_rng([77, i])) for i in range(150)]
    pages = [Page(h) for h, _ in made]
    x, up, base = features(pages)
    kept = html_extraction.decode(model.log_odds(x), up)
    truth = np.concatenate([[1, *labels] for _, labels in made]).astype(bool)
    assert (kept == truth).mean() > 0.995
    assert not (kept[1:] & (up[1:] >= 0) & ~kept[np.maximum(up[1:], 0)]).any()
    same = sum(blocks(p, kept[a:z]) == blocks(p, truth[a:z]) for p, a, z in zip(pages, base, base[1:], strict=False))
    assert same >= 0.93 * len(pages)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(5)
    for _ in range(30):
        up = np.array([-1, *(rng.integers(0, i) for i in range(1, 9))])
        odds = rng.normal(size=9)
        best = max((sum(odds[i] for i in range(9) if m >> i & 1) for m in range(512) if all(not m >> i & 1 or up[i] < 0 or m >> int(up[i]) & 1 for i in range(9))))
        assert odds[html_extraction.decode(odds, up)].sum() == pytest.approx(best)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.op4_quality(spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9 and out.score.between(0, 1).all()
    odd = quality.quality(documents(spark, ODD, True), labels)
    assert odd.count() == len(ODD) and odd.where("score is null").count() == 0
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(documents(spark, ["a"]), labels.limit(0)).first().score == 0.5


def test_passages_depend_on_their_own_text_alone():
    texts = ["", "  ", "One two. three", "\n\n", "x" * 900, "a b " * 200, "é ü!", " "]
    raw = lambda ts: (np.frombuffer("".join(ts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in ts])))
    x, base = quality.passages(*raw(texts))
    for i, t in enumerate(texts):
        alone, _ = quality.passages(*raw([t]))
        assert np.array_equal(alone, x[base[i] : base[i + 1]]), t


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, base, y = rng.normal(size=(9, 5)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1])
    m = quality.Attention(np.zeros(5), np.ones(5), 0.5)
    loss = lambda: -np.mean(y * np.log(p := m.score(x, base)) + (1 - y) * np.log(1 - p))
    g = m.gradients(x, base, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        keep, e = m.p[k][at], 1e-5
        m.p[k][at] = keep + e
        up = loss()
        m.p[k][at] = keep - e
        down = loss()
        m.p[k][at] = keep
        decay = quality.DECAY * keep * (k not in "bd")
        assert g[k][at] - decay == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(200)]
    texts, toxic = [], []
    for i in range(500):
        words = list(rng.choice(plain, 30))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(int(rng.integers(0, 30)), str(rng.choice(["idiot", "moron", "zzgrix" + rng.choice(plain)])))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = documents(spark, texts, True)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).toPandas().sort_values("doc_id")
    assert (out.predicted.to_numpy() == np.array(toxic)).mean() > 0.97
    assert toxicity.toxicity(documents(spark, ODD), labels).count() == len(ODD)
    assert toxicity.toxicity(documents(spark, ["a b"]), labels.limit(0)).first().predicted == 0


def test_chain_links_are_out_of_fold(monkeypatch):
    seen = []
    plain = toxicity.Linear.__init__

    def spy(self, doc, feature, dense, y):
        seen.append((len(y), dense.shape[1]))
        plain(self, doc, feature, dense, y)

    monkeypatch.setattr(toxicity.Linear, "__init__", spy)
    rng = np.random.default_rng(0)
    toxicity.Chain(np.repeat(np.arange(40), 5), rng.integers(0, 20, 200), (rng.random(40) < 0.5).astype(float))
    assert seen == [(x, c) for c in range(len(toxicity.CATEGORIES)) for x in (*[30] * toxicity.FOLDS, 40)]


# Operators 4 and 6 against plain versions of their own definitions, text by text.


def plain_passages(text):
    """The features of each passage of one text, word by word."""
    raw = text.encode()
    words, at = [], 0
    for part in __import__("re").finditer(rb"[^\x09-\x0d\x20]+", raw):
        words.append((part.start(), part.group()))
    out = []
    for p in range(max(1, -(-len(words) // quality.PASSAGE))):
        own = words[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
        row = np.zeros(quality.FEATURES, np.float32)
        if own:
            at = 0 if p == 0 else own[0][0]
            end = words[(p + 1) * quality.PASSAGE][0] if (p + 1) * quality.PASSAGE < len(words) else len(raw)
            counts = np.zeros(144)
            for i in range(at, end):
                if i + 1 < len(raw):  # the last byte of a passage pairs with the next passage's first
                    counts[quality._CLASS[raw[i]] * 12 + quality._CLASS[raw[i + 1]]] += 1
            row[:144] = np.sqrt(counts / max(1, end - at))
            sizes = [min(len(w), 40) for _, w in own]
            mean = sum(sizes) / len(own)
            row[144:147] = len(own) / quality.PASSAGE, mean / 10, np.sqrt(max(0, sum(x * x for x in sizes) / len(own) - mean**2)) / 5
            short = [(w[:7], len(w) % 256) for _, w in own]
            for lag in (1, 2, 3, 4):
                row[146 + lag] = sum(short[i] == short[i - lag] for i in range(lag, len(own))) / len(own)
            kinds = lambda i: [quality._CLASS[w[i]] for _, w in own]
            row[151] = sum(k == 1 for k in kinds(0)) / len(own)
            row[152] = sum(7 <= k <= 10 for k in kinds(-1)) / len(own)
            row[153] = sum(x == 1 for x in sizes) / len(own)
        out.append(row)
    return np.stack(out)


def test_quality_scores_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.op4_quality(spark, folder).collect()}
    p, sig = model.p, lambda x: 1 / (1 + np.exp(-x))
    for r in docs.orderBy("doc_id").limit(60).collect():
        h = np.tanh(((plain_passages(r.text or "") - model.mean) / model.scale) @ p["W"] + p["b"])
        gate = np.exp([float(np.tanh(x @ p["V"]) * sig(x @ p["U"]) @ p["w"]) for x in h])
        want = sig(sum(a * x for a, x in zip(gate / gate.sum(), h, strict=True)) @ p["c"] + p["d"][0])
        assert got[r.doc_id] == pytest.approx(float(want), abs=1e-5)


def test_toxicity_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, folder).collect()}
    one = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    for r in docs.orderBy("doc_id").limit(80).collect():
        words = Words(*one(r.text or ""))
        _, found = toxicity.features(words)
        n, counts = int(words.n[0]), {}
        for f in found.tolist():
            counts[f] = counts.get(f, 0) + 1
        has = {f * len(toxicity.LEVELS) + k for f, c in counts.items() for k, (least, share) in enumerate(toxicity.LEVELS) if c >= least and c >= share * n}
        before = []
        for name, m in zip(toxicity.CATEGORIES, chain.models, strict=True):
            s = m.d + sum(w for i, w in zip(m.ids.tolist(), m.w, strict=True) if i in has) + sum(v * x for v, x in zip(m.v, before, strict=True))
            before.append(m.constant if m.constant is not None else 1 / (1 + np.exp(-s)))
            assert got[r.doc_id][name] == pytest.approx(float(before[-1]), abs=1e-9)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.op6_toxicity(spark, folder).join(labels.selectExpr("doc_id", "toxic as label"), "doc_id").where("held_out").toPandas()
    toxic = out.label
    assert out.predicted[toxic == 1].mean() >= 0.9 and out.predicted[toxic == 0].mean() <= 0.005


def test_extraction_of_whole_pages_against_generated_layouts(spark):
    made = [layouts.generated(np.random.default_rng([78, i])) for i in range(60)]
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    want = []
    for h, roles in made:
        page = Page(h)
        want.append(blocks(page, np.array([1, *roles], bool)))
    assert sum(got[i] == w for i, w in enumerate(want)) >= 0.93 * len(made)


@pytest.mark.parametrize("tag", ["noscript", "xmp", "math", "object", "svg", "select"])
def test_nothing_of_an_article_is_lost_to_an_element(spark, tag):
    article = "".join(f"<p>Sentence number {i} of the article, with words, commas and more of it.</p>" for i in range(12))
    for html in (f"<{tag}>inner words</{tag}>", f"<{tag}>inner words"):
        page = f'<html><body><nav><a href="/">Home</a></nav><div id="content"><article><h1>Title</h1>{article[:300]}{html}{article[300:]}</article></div></body></html>'
        text = html_extraction.main_texts([page], html_extraction.trained())[0]
        assert text.count("Sentence number") == 12, (html, text)


def test_deep_pages_take_linear_time():
    model = html_extraction.trained()
    html = "<article>" + "<b>" * 20000 + "deep text, with words and commas." + "</b>" * 20000 + "<p>After it, more text of the article.</p></article>"
    began = __import__("time").time()
    html_extraction.main_texts([html], model)
    assert __import__("time").time() - began < 20
