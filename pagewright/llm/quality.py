"""Quality rules: counts over whole texts, then hashed n-gram logistic regression.

Features are relative frequencies of hashed words, word pairs and byte trigrams
of a text. The model is fitted on a bounded sample of labelled rows, its margin is
turned into a probability on rows kept apart for that (Platt scaling), and whole
Arrow batches are scored by table look-ups and sums against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .common import bounded_sample, fold, fold_of, slices, table, texts_of, with_workers

#: A text with fewer words fails, as does one with a larger percentage of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Kept if the probability of good quality reaches this.
THRESHOLD = 0.25
#: Labelled rows of each class that the fit reads at most; the fold kept apart for calibration.
ROWS_PER_CLASS, FOLDS, CALIBRATION = 1500, 5, 1
BITS = 16
SYMBOLS = b"#*$%&|<>"
U = np.uint64

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
_LEADS = (np.arange(256) & 0xC0 != 0x80).astype(np.uint8)


class Words:
    """Words of several texts, hashed once for counts and features alike."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        self.start, self.end, self.row = spans.words(buf, offsets)
        self.pre = spans.prefix(buf)
        self.hash = spans.span_hash(self.pre, self.start, self.end)
        self.count = spans.row_counts(self.row, self.n)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the k-word windows that stay in one row, and the windows' hashes."""
        if len(self.row) < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])
        h = self.hash[at]
        for j in range(1, k):
            h = spans.mix(h * U(0x9E3779B97F4A7C15) + self.hash[at + j])
        return at, h

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def same_words(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return spans.same_spans(self.buf, self.start[i], self.end[i], self.buf, self.start[j], self.end[j])

    def equals(self, k: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the k-word windows, the class of equal windows of a row that each is in, and whether an earlier one is."""
        at, h = self.windows(k) if k > 1 else (np.arange(len(self.row)), self.hash)

        def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = self.row[at[i]] == self.row[at[j]]
            for q in range(k):
                live = np.flatnonzero(out)
                out[live] = self.same_words(at[i[live]] + q, at[j[live]] + q)
            return out

        name = lambda i: (int(self.row[at[i]]), *(self.bytes_of(int(at[i]) + q) for q in range(k)))
        return at, *spans.groups(spans.in_row(h, self.row[at]), same, name)

    def repeated(self, k: int = 3) -> np.ndarray:
        """Words of each row in k-word windows that the row holds twice or more."""
        at, group, _ = self.equals(k)
        twice = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        cover = np.zeros(len(self.row) + k, np.int64)
        for j in range(k):
            cover[at[twice] + j] = 1
        return spans.row_counts(self.row[np.flatnonzero(cover[: len(self.row)])], self.n)

    def repeated_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word of each row, and those among them equal to an earlier line."""
        start, end, row = spans.lines(self.buf, self.offsets)
        some = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end, row = start[some], end[some], row[some]
        same = lambda i, j: (row[i] == row[j]) & spans.same_spans(self.buf, start[i], end[i], self.buf, start[j], end[j])
        name = lambda i: (int(row[i]), self.buf[start[i] : end[i]].tobytes())
        _, later = spans.groups(spans.in_row(spans.span_hash(self.pre, start, end), row), same, name)
        return spans.row_counts(row, self.n), spans.row_counts(row[later], self.n)


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The counts and the base verdict of each row."""
    solid = ~spans.SPACE[w.buf]
    n = {
        "n_words": w.count,
        "word_chars": spans.row_sums(_LEADS[w.buf] * solid, w.offsets),
        "n_symbols": spans.row_sums(_SYMBOL[w.buf], w.offsets),
        "n_dup_lines": w.repeated_lines()[1],
        "n_repeat_words": w.repeated(),
    }
    n["base_failed"] = (n["n_words"] < MIN_WORDS) | (100 * n["n_repeat_words"] > MAX_REPEAT_PERCENT * n["n_words"])
    return n


def _buckets(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of every feature: words, word pairs, byte trigrams, each in a block of its own."""
    size, shift = 1 << BITS, U(64 - BITS)
    at, pairs = w.windows(2)
    trigram = spans.grams(w.buf, 3)
    whole = np.ones(len(w.buf), bool)
    for k in (1, 2):
        stop = w.offsets[1:] - k
        whole[stop[stop >= 0]] = False
    p = np.flatnonzero(whole)
    scrambled = (trigram[p] * U(0x9E3779B97F4A7C15)) >> shift
    return [
        (w.row, (w.hash >> shift).astype(np.int64)),
        (w.row[at], (pairs >> shift).astype(np.int64) + size),
        (spans.owners(w.offsets, p) if len(p) else p, scrambled.astype(np.int64) + 2 * size),
    ]


def margins(w: Words, weights: np.ndarray) -> np.ndarray:
    """The linear part for each row: mean weight of its words, of its pairs, and of its trigrams."""
    out = np.full(w.n, weights[-1])
    for row, bucket in _buckets(w):
        total = np.bincount(row, weights[bucket], minlength=w.n)
        out += total / np.maximum(np.bincount(row, minlength=w.n), 1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a margin into a probability (Newton steps on smoothed targets)."""
    pos, neg = label.sum(), len(label) - label.sum()
    if not len(label):
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.zeros(2)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ ab)
        grad = x.T @ (p - target) + 1e-6 * ab
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """Feature weights (bias last) and the calibration."""

    def __init__(self, weights: np.ndarray, slope: float = 1.0, intercept: float = 0.0):
        self.weights, self.slope, self.intercept = weights, slope, intercept

    def probability(self, w: Words) -> np.ndarray:
        """Probability that each row is of good quality."""
        return _sigmoid(self.slope * margins(w, self.weights) + self.intercept)


def fit(column: pa.Array, label: np.ndarray, apart: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Logistic regression by AdaGrad over the whole sample, classes weighted alike; then calibration."""
    size = 3 << BITS
    parts, base = [], 0
    for _, _, buf, offsets in slices(column):
        w = Words(buf, offsets)
        for row, bucket in _buckets(w):
            key, count = np.unique(row * size + bucket, return_counts=True)
            r = key // size
            share = count / np.bincount(row, minlength=w.n)[r]
            parts.append(((r + base).astype(np.int32), (key % size).astype(np.int32), share.astype(np.float32)))
        base += w.n
    row, col, val = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
    parts.clear()
    use = np.flatnonzero(np.bincount(col, minlength=size))
    place = np.zeros(size, np.int32)
    place[use] = np.arange(len(use))
    col = place[col]
    train = ~apart
    weight = np.where(label == 1, 0.5 / max(1, (label[train] == 1).sum()), 0.5 / max(1, (label[train] == 0).sum())) * train
    w, b, g2, gb2 = np.zeros(len(use)), 0.0, np.full(len(use), 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, val * w[col], minlength=base) + b
        err = weight * (_sigmoid(z) - label)
        grad = np.bincount(col, val * err[row], minlength=len(use)) + decay * w
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
        gb2 += err.sum() ** 2
        b -= rate * err.sum() / np.sqrt(gb2)
    z = np.bincount(row, val * w[col], minlength=base) + b
    weights = np.zeros(size + 1)
    weights[use], weights[-1] = w, b
    held = apart if apart.any() else train
    return Model(weights, *platt(z[held], label[held]))


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, per_class: int, folds: int, held_out: int | None) -> pa.Table:
    """``(doc_id, text, label)`` of up to ``per_class`` labelled rows of each class, the held-out fold left out.

    Only ids are ranked; the texts of the picked ids come by a broadcast of those, one for each id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if held_out is not None:
        known = known.filter(fold("doc_id", folds) != held_out)
    picked = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), ["label"], "doc_id", per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts_of(rows, picked, ["doc_id"]).select("doc_id", "text", "label").toArrow().combine_chunks().sort_by("doc_id")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside fold 0 of 5; without labelled rows the model keeps everything."""
    rows = labelled(spark, docs, labels, "quality", ROWS_PER_CLASS, FOLDS, 0)
    if not rows.num_rows or len(set(rows.column("label").to_pylist())) < 2:
        weights = np.zeros((3 << BITS) + 1)
        weights[-1] = 10.0
        return Model(weights)
    apart = fold_of(rows.column("doc_id"), FOLDS) == CALIBRATION
    return fit(rows.column("text"), rows.column("label").to_numpy().astype(float), apart)


def judged(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """All counts, verdicts and the probability of each row of a text column."""
    parts = []
    for _, _, buf, offsets in slices(column):
        w = Words(buf, offsets)
        part = base_counts(w)
        part["probability"] = model.probability(w)
        part["kept"] = ~part["base_failed"] & (part["probability"] >= THRESHOLD)
        parts.append(part)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kinds = [np.int64] * 5 + [bool, np.float64, bool]
    return {k: np.concatenate([np.zeros(0, t), *(p[k].astype(t) for p in parts)]) for k, t in zip(names, kinds, strict=True)}


def assess(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: counts, base verdict, probability, and whether it is kept.

    Null and empty texts have no words and fail. Repeated rows give repeated results, an empty table an
    empty one; a probability equal to the threshold is kept. Columns other than doc_id and text are ignored.
    """
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judged(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, got.values())], ["doc_id", *got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return rows.mapInArrow(run, schema)


def keep_good(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judged(batch.column("text").cast(pa.string()), shared.value)["kept"]))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    docs = table(spark, sf_dir, "documents")
    return assess(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of ``op3_quality_rules``, which SQL can express (``BASE_SQL``)."""
    none = np.zeros((3 << BITS) + 1)
    return assess(spark, table(spark, sf_dir, "documents"), Model(none)).drop("probability", "kept")


_WORD = r"[^\x20\x09-\x0D]"
BASE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM texts),
windows AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id),
counts AS (SELECT p.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN covered c ON c.doc_id = p.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts
"""
