"""Operator 3: main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes its DOM nodes, with features of the node and its place: tag, attribute tokens of itself and its ancestors,
depth, text and link density of its subtree, sibling statistics, position. Boosted trees give each node the odds that it
belongs to the article (or encloses it). Decoding picks the kept set of the highest total odds in which a kept node's
ancestors are all kept: a subtree's gain is its node's log odds plus its children's gains where positive; a node is kept if
its gain is positive and its parent is kept. Contradictory choices along a path can't arise.

The trees are trained here, on TRAIN_PAGES generated pages of many layouts (``layouts``) in which every node's role is
known; the pages table is no training data. Texts of kept nodes make up blocks; nothing else is dropped or cut.

Nulls: null html is an empty page and has empty text; null ids and urls keep their rows. Repeated rows are rows of their
own. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready_workers, table
from .html_nodes import Page, blocks, by_level, features
from .layouts import generated

TRAIN_PAGES, SEED = 420, 3
TREES, DEPTH, RATE, BINS, RIDGE = 60, 4, 0.25, 32, 2.0
BATCH_PAGES = 256


class Trees:
    """Boosted regression trees for a binary label: histograms of quantile bins, second-order splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        flat = binned + np.arange(f) * BINS
        prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        self.feature = np.zeros((TREES, inner), np.int64)
        self.cut = np.full((TREES, inner), np.inf, np.float32)
        self.leaf = np.zeros((TREES, leaves))
        score, rng = np.full(n, self.start), np.random.default_rng(SEED)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
            columns = np.sort(rng.permutation(f)[: f * 2 // 3])
            some = flat[:, columns]
            for d in range(DEPTH):
                width, first = 1 << d, (1 << d) - 1
                slot = (node[:, None] * (f * BINS) + some).ravel()
                hist = [np.bincount(slot, np.repeat(v, len(columns)), width * f * BINS).reshape(width, f, BINS) for v in (g, h)]
                left = [v.cumsum(2)[:, :, :-1] for v in hist]
                total = [v.sum(2, keepdims=True) for v in hist]
                gain = left[0] ** 2 / (left[1] + RIDGE) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                gain = gain.reshape(width, -1)
                best = gain.argmax(1)
                column, edge = best // (BINS - 1), best % (BINS - 1)
                for k in range(width):
                    j, e = int(column[k]), int(edge[k])
                    if gain[k, best[k]] > 1e-6 and e < len(self.cuts[j]):
                        self.feature[t, first + k], self.cut[t, first + k] = j, self.cuts[j][e]
                at = first + node
                node = 2 * node + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            values = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
            self.leaf[t] = RATE * values
            score += self.leaf[t][node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        score, rows, flat = np.full(n, self.start), np.arange(n) * x.shape[1], np.ascontiguousarray(x).ravel()
        for t in range(TREES):
            node, feature, cut = np.zeros(n, np.int64), self.feature[t], self.cut[t]
            for d in range(DEPTH):
                at = node + ((1 << d) - 1)
                node = 2 * node + (flat[rows + feature[at]] > cut[at])
            score += self.leaf[t][node]
        return score


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The model; the same wherever it is trained."""
    made = [generated(np.random.default_rng([SEED, i])) for i in range(TRAIN_PAGES)]
    pages = [Page(html) for html, _ in made]
    for p, (_, labels) in zip(pages, made, strict=True):
        assert len(p.tags) == len(labels) + 1, (len(p.tags), len(labels))
    x, _, _ = features(pages)
    return Trees(x, np.array([v for _, labels in made for v in (1, *labels)], float))


def decode(odds: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The kept nodes: the best set that has every kept node's parent."""
    rows = by_level(up)
    gain = odds.copy()
    for r in rows[:0:-1]:
        np.add.at(gain, up[r], np.maximum(gain[r], 0))
    kept = gain > 0
    for r in rows[1:]:
        kept[r] &= kept[up[r]]
    return kept


def main_texts(htmls: list[str], model: Trees) -> list[str]:
    """The main text of each page."""
    out = []
    for i in range(0, len(htmls), BATCH_PAGES):
        pages = [Page(h) for h in htmls[i : i + BATCH_PAGES]]
        x, up, base = features(pages)
        kept = decode(model.log_odds(x), up)
        out += [blocks(p, kept[a:z]) for p, a, z in zip(pages, base[:-1].tolist(), base[1:].tolist(), strict=True)]
    return out


def extracted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = main_texts(b.column("html").to_pylist(), model.value)
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ready_workers(spark)
    model = spark.sparkContext.broadcast(trained())  # of fixed size
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(lambda it: extracted(it, model), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE_SQL: dict[str, str] = {}
