"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are complete to a fixed depth and lie flat in three arrays, so a batch of
texts walks all of them by a handful of array look-ups per level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fold, slices, table, with_workers
from .quality import Words, labelled

#: Labelled rows of each class that the fit reads at most; labels of fold 0 of 5 are never learnt.
ROWS_PER_CLASS, FOLDS, HELD_OUT = 3000, 5, 0
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAF_WEIGHT = 80, 4, 64, 0.15, 1.0, 2.0

_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>=+^~@_\\/{}[]")),
    "exclaim": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "pipe": np.arange(256) == 124,
    "blank": spans.SPACE,
    "high": np.arange(256) >= 128,
}

NAMES = ["log_bytes", "log_words", "bytes_per_word", "log_lines", "words_per_line", "dup_lines", "distinct_words", "repeated_3", "repeated_pairs", "top_word", *_CLASSES]


def statistics(w: Words) -> np.ndarray:
    """One row of numbers per text; an empty text has all zeros."""
    size = np.diff(w.offsets)
    some, many = np.maximum(size, 1), np.maximum(w.count, 1)
    n_lines, dup = w.repeated_lines()
    _, group, later = w.equals()
    first = np.flatnonzero(~later)
    top = np.zeros(w.n)
    np.maximum.at(top, w.row[first], np.bincount(group)[group[first]] if len(first) else 0)
    columns = [
        np.log1p(size), np.log1p(w.count), size / many, np.log1p(n_lines), w.count / np.maximum(n_lines, 1), dup / np.maximum(n_lines, 1),
        spans.row_counts(w.row[first], w.n) / many, w.repeated(3) / many, w.repeated(2) / many, top / many,
    ]
    columns += [spans.row_sums(mask.astype(np.uint8)[w.buf], w.offsets) / some for mask in _CLASSES.values()]
    return np.stack(columns, axis=1).astype(np.float64)


class Trees:
    """Flat trees: split feature and threshold of every inner node, value of every leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        tree = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boost on the logistic loss with histogram splits, exact second-order leaf values."""
    inner = (1 << depth) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            gain, split = np.full(width, 1e-6), [(0, np.inf)] * width
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key = at * (BINS + 1) + bins[:, j]
                gs = np.bincount(key, g, minlength=width * (BINS + 1)).reshape(width, -1)
                hs = np.bincount(key, h, minlength=width * (BINS + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(axis=1)[:, : len(cut)], hs.cumsum(axis=1)[:, : len(cut)]
                ga, ha = gs.sum(axis=1)[:, None], hs.sum(axis=1)[:, None]
                score = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                score[(hl < LEAF_WEIGHT) | (ha - hl < LEAF_WEIGHT)] = -np.inf
                best = score.argmax(axis=1)
                for k in np.flatnonzero(score[np.arange(width), best] > gain):
                    gain[k], split[k] = score[k, best[k]], (j, float(cut[best[k]]))
            f, c = np.array([s[0] for s in split]), np.array([s[1] for s in split])
            feature[t, first : first + width], threshold[t, first : first + width] = f, c
            node = 2 * node + 1 + (x[np.arange(len(x)), f[at]] > c[at])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + RIDGE)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def features(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(NAMES))), *(statistics(Words(buf, offsets)) for _, _, buf, offsets in slices(column))])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Trees:
    """Fit on labelled rows outside fold 0 of 5; with no rows or one class only, a constant."""
    rows = labelled(spark, docs, labels, "quality", ROWS_PER_CLASS, FOLDS, HELD_OUT)
    y = rows.column("label").to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        inner = (1 << DEPTH) - 1
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 4.0 if not len(y) or y[0] else -4.0)
    return fit(features(rows.column("text")), y)


def classify(spark: SparkSession, docs: DataFrame, model: Trees) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``; null text counts as empty and has a score too.

    Repeated rows give repeated results, an empty table an empty one; texts are scored whole,
    a megabyte or one longer text at a time. Other columns are ignored.
    """
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = classify(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
