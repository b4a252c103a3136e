"""Operator 4: document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by the shares of its byte-class pairs and by
word statistics, and encoded by a small tanh layer. Gated attention, learned from document labels alone, weighs the
passages; the weighted mean of their codes is scored by a logistic layer. Labels are learned only from rows with
crc32(doc_id as text) mod 5 <> 0; nothing but the text is an input of a score.

The model is fitted on the driver to at most FIT_DOCS labelled documents (those of least hash), fewer if the features of
their passages are beyond FIT_BYTES; of each, all passages. Every document is then scored over all of its passages.

Nulls: a null text is empty; an empty text is one passage of zeros. Labels that are null or not 0 or 1 are not learned
from; of several labels of a document all are. Null ids keep their rows, as not held out. Empty tables: no rows; without
labels of both kinds the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready_workers, stored, table, tidy, trimmed, utf8

PASSAGE = 48
FIT_DOCS, FIT_BYTES = 4000, 64 << 20
KEEP_AT = 0.3
CODE, GATE, STEPS, BAGS, RATE, DECAY, SEED = 24, 12, 900, 128, 0.01, 1e-4, 4

#: Byte classes: lower, upper, digit, space, newline, full stop, comma-like, ! and ?, bar, symbols, other ASCII, high bytes.
_KINDS = 12
_CLASS = np.full(256, 10, np.uint8)
for _k, _members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",;:", "!?", "|", "#$%&*@^~<>=+\\")):
    _CLASS[[ord(c) for c in _members]] = _k
_CLASS[128:] = 11
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)], "<u8")
FEATURES = _KINDS * _KINDS + 10


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each passage of each text, and each text's first passage; a text has at least one."""
    docs = len(offsets) - 1
    inside = ~_SPACE[raw]
    begins, first = inside.copy(), np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    of = np.searchsorted(starts, offsets)
    words = np.diff(of)
    bags = np.maximum(1, -(-words // PASSAGE))
    base = np.append(0, np.cumsum(bags))
    rank = np.arange(len(starts)) - np.repeat(of[:-1], words)
    passage = np.repeat(base[:-1], words) + rank // PASSAGE
    total = int(base[-1])
    # Bytes belong to the passage of the word before them.
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    cuts = starts[heads]
    is_first = rank[heads] == 0
    cuts = np.where(is_first, offsets[:-1][np.searchsorted(base, passage[heads], "right") - 1], cuts)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(cuts):
        return out, base
    kind = _CLASS[raw].astype(np.int32)
    pair = kind[:-1] * _KINDS + kind[1:] if len(kind) > 1 else np.zeros(0, np.int32)
    # A passage ends where the next of its text begins, or with its text; what lies between belongs to none.
    text = np.searchsorted(base, passage[heads], "right") - 1
    ends_at = np.minimum(np.append(cuts[1:], len(raw)), offsets[1:][text])
    size, none = ends_at - cuts, len(cuts)
    lengths = np.empty(2 * none + 1, np.int64)
    lengths[0::2], lengths[1::2] = np.append(cuts, len(raw)) - np.append(0, ends_at), size
    slots = np.full(2 * none + 1, none, np.int32)
    slots[1::2] = np.arange(none)
    slot = np.repeat(slots, lengths)
    slot[offsets[1:][np.diff(offsets) > 0] - 1] = none  # a text's last byte pairs with nothing
    counts = np.bincount(slot[: len(pair)] * np.int64(_KINDS * _KINDS) + pair, minlength=(none + 1) * _KINDS * _KINDS)
    counts = counts.reshape(none + 1, -1)[:none]
    out[passage[heads], : _KINDS * _KINDS] = np.sqrt(counts / np.maximum(1, size)[:, None])
    # Words: length, spread of lengths, repeats at short distances, kinds of first and last letters.
    ends = np.flatnonzero(inside & np.append(~inside[1:] | first[1:-1], True)) + 1
    long = np.minimum(ends - starts, 40).astype(np.float64)
    head8 = np.ndarray((len(raw) + 8,), "<u8", raw.tobytes() + bytes(16), strides=(1,))[starts]
    head8 = (head8 & _HEAD[np.minimum(ends - starts, 7)]) ^ ((ends - starts).astype("<u8") << np.uint64(56))
    n = np.bincount(passage, minlength=total).astype(np.float64)
    n1 = np.maximum(n, 1)
    mean = np.bincount(passage, long, total) / n1
    rows = [n / PASSAGE, mean / 10, np.sqrt(np.maximum(0, np.bincount(passage, long * long, total) / n1 - mean**2)) / 5]
    for lag in (1, 2, 3, 4):
        same = np.zeros(len(starts))
        same[lag:] = (head8[lag:] == head8[:-lag]) & (passage[lag:] == passage[:-lag])
        rows.append(np.bincount(passage, same, total) / n1)
    rows.append(np.bincount(passage, _CLASS[raw[starts]] == 1, total) / n1)
    rows.append(np.bincount(passage, (_CLASS[raw[ends - 1]] >= 7) & (_CLASS[raw[ends - 1]] <= 10), total) / n1)
    rows.append(np.bincount(passage, long == 1, total) / n1)
    out[:, _KINDS * _KINDS :] = np.stack(rows, 1)
    return out, base


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder, gated attention and logistic layer over bags of instances."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float) -> None:
        rng, f = np.random.default_rng(SEED), len(mean)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": rng.normal(0, f**-0.5, (f, CODE)), "b": np.zeros(CODE), "V": rng.normal(0, CODE**-0.5, (CODE, GATE)),
            "U": rng.normal(0, CODE**-0.5, (CODE, GATE)), "w": rng.normal(0, 0.1, GATE), "c": rng.normal(0, 0.1, CODE), "d": np.array([np.log(prior / (1 - prior))]),
        }

    def forward(self, x: np.ndarray, base: np.ndarray) -> dict:
        p, sizes = self.p, np.diff(base)
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, base[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, base[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, base[:-1], 0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        return self.forward(x, base)["y"] if len(base) > 1 else np.zeros(0)

    def gradients(self, x: np.ndarray, base: np.ndarray, y: np.ndarray) -> dict:
        p, sizes, f = self.p, np.diff(base), self.forward(x, base)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        ds = (f["y"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], sizes, 0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, base[:-1]), sizes))
        dg = de[:, None] * p["w"]
        dt, du = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        g = {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * s).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}
        return {k: v + DECAY * p[k] * (k not in "bd") for k, v in g.items()}

    def fit(self, x: np.ndarray, base: np.ndarray, y: np.ndarray) -> Attention:
        """Adam over random batches of bags, with a falling rate."""
        rng, first, second = np.random.default_rng(SEED), {}, {}
        sizes = np.diff(base)
        for step in range(1, STEPS + 1):
            bags = rng.integers(0, len(y), BAGS)
            n = sizes[bags]
            at = np.repeat(base[bags] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            rate = RATE * (1 - step / (STEPS + 1))
            for k, g in self.gradients(x[at], np.append(0, np.cumsum(n)), y[bags]).items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


class Constant:
    def __init__(self, value: float) -> None:
        self.value = value

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.full(len(base) - 1, self.value)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A training document's passages as bytes of half-precision numbers."""
    for b in batches:
        x, base = passages(*utf8(b.column("text")))
        data = [x[i:j].astype("<f2").tobytes() for i, j in zip(base[:-1], base[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("label"), pa.array(data, pa.binary())], ["place", "label", "data"])


def held_out(doc_id="doc_id"):
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@tidy
def fit_data(docs: DataFrame, labels: DataFrame, column: str, most: int, most_bytes: int, featured) -> tuple[np.ndarray, list[bytes]]:
    """Labels and features of the rows to learn from: at most ``most`` labelled documents, those of least hash of the id.

    Features are made and kept on the executors' side first; of documents in the order of the hash as many come to the driver
    as have no more than ``most_bytes`` of features. featured: (place, label, text) to (place, label, data).
    """
    few = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    few = few.select(F.xxhash64("doc_id").alias("place"), "doc_id", F.col(column).cast("double").alias("label")).distinct().orderBy("place", "label").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").select("place", "label", "text")
    rows = stored(rows.mapInArrow(lambda it: trimmed(featured(it)), "place long, label double, data binary"))
    size, last = 0, None
    for r in rows.groupBy("place").agg(F.sum(F.length("data")).alias("n")).orderBy("place").collect():  # ``most`` at most
        size += r["n"]
        if size > most_bytes:
            break
        last = r["place"]
    chosen = rows.where(F.col("place") <= last).collect() if last is not None else []
    chosen.sort(key=lambda r: (r["place"], r["label"], bytes(r["data"])))
    return np.array([r["label"] for r in chosen]), [bytes(r["data"]) for r in chosen]


def fit(docs: DataFrame, labels: DataFrame):
    """The model of the labels' column ``quality``."""
    y, data = fit_data(docs, labels, "quality", FIT_DOCS, FIT_BYTES, featured)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(d, "<f2").reshape(-1, FEATURES) for d in data]
    x, base = np.concatenate(bags, dtype=np.float32, casting="same_kind"), np.append(0, np.cumsum([len(b) for b in bags]))
    return Attention(x.mean(0, np.float64), x.std(0, np.float64) + 0.05, float(y.mean())).fit(x, base, y)


def scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = model.score(*passages(*utf8(b.column("text"))))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(score, pa.float64())], [*(c for c in b.schema.names if c != "text"), "score"])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality."""
    ready_workers(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda it: trimmed(scored(it, model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier keeps. It is told by each row's text, so rows without an id, too, are judged alone."""
    ready_workers(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    schema = docs.schema

    def kept(batches):
        for b in batches:
            text = b.column("text").fill_null("")
            yield b.filter(pa.array(model.score(*passages(*utf8(text))) >= KEEP_AT))

    return docs.mapInArrow(lambda it: trimmed(kept(it)), schema)


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
