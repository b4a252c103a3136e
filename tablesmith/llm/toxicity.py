"""Operator 6: toxicity by a classifier chain of linear models.

Categories are predicted one after the other: KINDS kinds of toxicity, then ``toxic`` as a whole. The kinds are learned: the
labelled table only says toxic or not, so the toxic training rows are grouped by the features that tell them from others
(spherical k-means), the commonest kind first. Each category is a logistic model over the hashed words and word beginnings
of the text, each at several levels of how often it occurs, and over the probabilities of all earlier categories. For its
training those are out-of-fold: each row's come from models that were fitted without that row's fold.

Models are fitted on the driver to at most FIT_DOCS labelled documents (those of least hash, not held out as in the quality
operator), fewer if their features are beyond FIT_BYTES; of each, whole texts. Every document is then scored over its whole
text.

Nulls: a null text is empty and gets the models' base rates. Labels that are null or not 0 or 1 are not learned from. Null
ids keep their rows. Empty tables: no rows; a category without training rows of both kinds has its share as its constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready_workers, table, utf8
from .decontamination import _K, _MASK, Words, _mix
from .quality import _sigmoid, fit_data, held_out

FIT_DOCS, FIT_BYTES, FOLDS, SPACE_BITS = 6000, 64 << 20, 4, 21
#: Features that a model keeps, by the strength of their tie to its label; training texts that a feature must be in.
KEPT, LEAST_DOCS = 300, 3
STEPS, RATE, RIDGE = 150, 0.2, 1e-2
FLAG_AT = 0.3
KINDS, STARTS, ROUNDS = 3, 8, 12
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")
#: Lengths in bytes of the word beginnings; how often a feature occurs at least, in all and by words of the text, for each level.
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = ((1, 0.0), (2, 0.0), (2, 1 / 64), (4, 1 / 128))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all features: the word itself and its beginnings."""
    clean = np.ndarray((len(words.clean) + 8,), "<u8", words.clean + bytes(16), strides=(1,))
    head, size = clean[words.starts], words.ends - words.starts
    out, at = [words.hashes], [np.arange(len(head))]
    for k in BEGINNINGS:
        enough = np.flatnonzero(size > k)
        out.append(_mix((head[enough] & _MASK[k]) * _K[1] + np.uint64(k)))
        at.append(enough)
    return np.concatenate(at), (np.concatenate(out) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def present(raw: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature at a level) of the features in each text, by text. chosen: a table of the features to look for.

    A feature's number times the number of levels, plus a level's place, is the feature at that level.
    """
    w = Words(raw, offsets)
    word, feature = features(w)
    if chosen is not None:
        hit = chosen[feature]
        word, feature = word[hit], feature[hit]
    text = np.searchsorted(w.of, word, "right") - 1
    pair, count = np.unique(text << SPACE_BITS | feature, return_counts=True)
    text, feature = pair >> SPACE_BITS, pair & ((1 << SPACE_BITS) - 1)
    at = [np.flatnonzero((count >= least) & (count >= share * w.n[text])) for least, share in LEVELS]
    texts, levels = np.concatenate([text[i] for i in at]), np.concatenate([feature[i] * len(LEVELS) + k for k, i in enumerate(at)])
    order = np.lexsort((levels, texts))
    return texts[order], levels[order]


def common(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, ids): the features of LEAST_DOCS texts or more, numbered by their place among them; ids: by place."""
    ids, place, count = np.unique(feature, return_inverse=True, return_counts=True)
    enough = count >= LEAST_DOCS
    keep = enough[place]
    return doc[keep], (np.cumsum(enough) - 1)[place[keep]], ids[enough]


def ties(doc: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How strongly each feature is tied to the label: a log-likelihood ratio of its presence, times the difference in presence."""
    n1, n0, size = y.sum(), (1 - y).sum(), int(feature.max(initial=-1)) + 1
    has1, has0 = np.bincount(feature, y[doc], size), np.bincount(feature, 1 - y[doc], size)
    p1, p0 = (has1 + 0.5) / (n1 + 1), (has0 + 0.5) / (n0 + 1)
    return np.where(has1 + has0 >= LEAST_DOCS, (p1 - p0) * np.log(p1 / p0), 0)


def kinds(doc: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[row, kind]: which kind each toxic row is of, by spherical k-means over the KEPT features most tied to the label."""
    out = np.zeros((len(y), KINDS))
    rows = np.flatnonzero(y)
    if not len(rows) or len(rows) == len(y):
        return out
    tie = ties(doc, feature, y)
    ids = np.sort(np.argsort(-tie, kind="stable")[:KEPT])
    if not len(ids):
        return out
    at = np.minimum(np.searchsorted(ids, feature), len(ids) - 1)
    hit = (ids[at] == feature) & (y[doc] > 0)
    x = np.zeros((len(rows), len(ids)), np.float32)
    x[np.searchsorted(rows, doc[hit]), at[hit]] = tie[ids[at[hit]]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng, best, own = np.random.default_rng(KINDS), -1.0, None
    for _ in range(STARTS):
        c = x[rng.choice(len(x), KINDS, replace=len(x) < KINDS)]
        for _ in range(ROUNDS):
            near = np.argmax(x @ c.T, 1)
            c = np.stack([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(KINDS)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        if (good := float((x @ c.T).max(1).sum())) > best:
            best, own = good, np.argmax(x @ c.T, 1)
    order = np.argsort(-np.bincount(own, minlength=KINDS), kind="stable")
    out[rows, np.argsort(order)[own]] = 1
    return out


class Linear:
    """Logistic regression over chosen sparse features and a few dense ones, fitted by Adagrad."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, dense: np.ndarray, y: np.ndarray) -> None:
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            self.ids, self.w, self.v, self.d = np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), 0.0
            return
        n1, n0 = y.sum(), (1 - y).sum()
        tie = ties(doc, feature, y)
        ids = np.argsort(-tie, kind="stable")[:KEPT]
        self.ids = np.sort(ids[tie[ids] > 0])
        at = np.searchsorted(self.ids, feature)
        hit = self.ids[np.minimum(at, len(self.ids) - 1)] == feature if len(self.ids) else np.zeros(len(feature), bool)
        doc, at = doc[hit], at[hit]
        self.w, self.v, self.d = np.zeros(len(self.ids)), np.zeros(dense.shape[1]), float(np.log(n1 / n0))
        sums = [np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6]
        for _ in range(STEPS):
            s = np.bincount(doc, self.w[at], len(y)) + dense @ self.v + self.d
            g = (_sigmoid(s) - y) / len(y)
            steps = (np.bincount(at, g[doc], len(self.w)) + RIDGE / 100 * self.w, dense.T @ g + RIDGE * self.v, g.sum())
            for i, x in enumerate(steps):
                sums[i] = sums[i] + x * x
            self.w = self.w - RATE * steps[0] / np.sqrt(sums[0])
            self.v = self.v - RATE * steps[1] / np.sqrt(sums[1])
            self.d -= RATE * steps[2] / np.sqrt(sums[2])

    def predict(self, doc: np.ndarray, feature: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        if not len(self.ids):
            return _sigmoid(dense @ self.v + self.d)
        at = np.minimum(np.searchsorted(self.ids, feature), len(self.ids) - 1)
        hit = self.ids[at] == feature
        return _sigmoid(np.bincount(doc[hit], self.w[at[hit]], len(dense)) + dense @ self.v + self.d)


class Chain:
    """Models of CATEGORIES in order; each sees the probabilities of those before it. toxic: the label of each training row."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> None:
        n = len(toxic)
        doc, feature, ids = common(doc, feature)
        labels = np.column_stack([kinds(doc, feature, toxic), toxic]).reshape(n, len(CATEGORIES))
        fold = np.random.default_rng(6).permutation(n) % FOLDS
        self.models, dense = [], np.zeros((n, 0))
        for c in range(len(CATEGORIES)):
            y, outside = labels[:, c], np.zeros(n)
            for k in range(FOLDS):
                learn = fold != k
                number = np.cumsum(learn) - 1
                mine = learn[doc]
                model = Linear(number[doc[mine]], feature[mine], dense[learn], y[learn])
                number = np.cumsum(~learn) - 1
                outside[~learn] = model.predict(number[doc[~mine]], feature[~mine], dense[~learn])
            self.models.append(Linear(doc, feature, dense, y))
            dense = np.column_stack([dense, outside])
        self.chosen = np.zeros(1 << SPACE_BITS, bool)
        for m in self.models:
            m.ids = ids[m.ids]
            self.chosen[m.ids // len(LEVELS)] = True

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = present(raw, offsets, self.chosen)
        dense = np.zeros((len(offsets) - 1, 0))
        for m in self.models:
            dense = np.column_stack([dense, m.predict(doc, feature, dense)])
        return dense


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A training document's features as bytes."""
    for b in batches:
        doc, feature = present(*utf8(b.column("text")))
        cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
        data = [feature[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("label"), pa.array(data, pa.binary())], ["place", "label", "data"])


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain for the labels' column ``toxic``."""
    toxic, data = fit_data(docs, labels, "toxic", FIT_DOCS, FIT_BYTES, featured)
    found = [np.frombuffer(d, "<i4") for d in data]
    doc = np.repeat(np.arange(len(toxic)), [len(d) for d in found]).astype(np.int64)
    feature = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int64)
    return Chain(doc, feature, toxic)


def scored(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = chain.value.predict(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in p.T)], ["doc_id", *CATEGORIES])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the probabilities of CATEGORIES, predicted for every row of docs (doc_id, text)."""
    ready_workers(docs.sparkSession)
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # some MB, set by KEPT and SPACE_BITS
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda it: scored(it, chain), "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    return out.withColumn("predicted", (F.col("toxic") >= FLAG_AT).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by category."""
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), *CATEGORIES, "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
