"""Language identification by prediction by partial matching over bytes.

One variable-order context tree per language, grown from a bounded sample of
labelled texts and then frozen. A byte costs its code length in bits: from the
longest context that has met it, plus the escapes out of every longer context
that has not (escape method C). A text's code length is the exact sum over all of
its bytes; the language with the shortest code wins.

A byte's cost depends on the byte and at most ``ORDER`` bytes before it, so each
distinct window is costed once and remembered in a direct-mapped table; the rest
is gathers and sums over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .common import MOST_BYTES, bounded_sample, fold, slices, table, texts_of, with_workers

#: Bytes of context; labelled texts per language that the trees grow from.
ORDER, TEXTS_PER_LANGUAGE = 4, 400
#: Labels hold out the documents of this fold.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Slots of the table of remembered windows.
SLOTS = 1 << 18

_LETTER = regex.compile(r"\p{L}")
U = np.uint64


def windows(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte (lowest) with up to ``ORDER`` bytes before it, packed; nulls stand before a text's start."""
    out = buf.astype(U)
    for k in range(1, ORDER + 1):
        out[k:] |= buf[:-k].astype(U) << U(8 * k) if k < len(buf) else U(0)
    for j in range(ORDER):  # what stands before a text is not its context
        at = offsets[:-1] + j
        out[at[at < offsets[1:]]] &= U((1 << (8 * (j + 1))) - 1)
    return out


class ContextTree:
    """Frozen statistics of one language: for each order, what follows each context how often."""

    def __init__(self, keys: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            k, c = np.unique(keys & U((1 << (8 * (order + 1))) - 1), return_counts=True)
            context, at, distinct = np.unique(k >> U(8), return_index=True, return_counts=True)
            total = np.add.reduceat(c, at) if len(c) else c
            escape = np.log2((total + distinct) / distinct)
            row = np.repeat(np.arange(len(context)), distinct)
            cost = np.log2((total[row] + distinct[row]) / c) if len(c) else c.astype(float)
            self.levels.append((k, cost.astype(np.float32), context, escape.astype(np.float32)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each window's last byte."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            grams, cost, contexts, escape = self.levels[order]
            if not len(open_) or not len(grams):
                break
            part = keys[open_] & U((1 << (8 * (order + 1))) - 1)
            at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
            hit = grams[at] == part
            out[open_[hit]] += cost[at[hit]]
            open_, part = open_[~hit], part[~hit] >> U(8)
            at = np.minimum(np.searchsorted(contexts, part), len(contexts) - 1)
            known = contexts[at] == part
            out[open_[known]] += escape[at[known]]
        out[open_] += 8.0  # never met: one of 256 bytes
        return out


class Model:
    """Context trees by language, and the windows costed so far in this process."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        self.keys: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"keys": None, "costs": None}

    def costs_of(self, keys: np.ndarray) -> np.ndarray:
        if self.keys is None:
            self.keys = np.full(SLOTS, (1 << 64) - 1, U)
            self.costs = np.zeros((SLOTS, len(self.trees)), np.float32)
        slot = ((keys * U(0x9E3779B97F4A7C15)) >> U(46)).astype(np.int64)
        miss = np.flatnonzero(np.take(self.keys, slot) != keys)
        out = np.take(self.costs, slot, axis=0)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            fresh = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            out[miss] = fresh[back]
            place = ((new * U(0x9E3779B97F4A7C15)) >> U(46)).astype(np.int64)
            self.keys[place], self.costs[place] = new, fresh
        return out

    def code_lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits for every row and language."""
        costs = self.costs_of(windows(buf, offsets))
        out = np.zeros((len(offsets) - 1, len(self.trees)))
        upto = np.zeros(len(buf) + 1)
        for j in range(len(self.trees)):
            np.cumsum(costs[:, j], dtype=np.float64, out=upto[1:])
            out[:, j] = upto[offsets[1:]] - upto[offsets[:-1]]
        return out

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of that language among all (0 to 1), and bits a byte, for every row."""
        langs, scores, rates = [], [], []
        for lo, hi, buf, offsets in slices(column):
            size = np.maximum(np.diff(offsets), 1)
            text, at = buf.tobytes(), offsets.tolist()
            letters = np.array([bool(_LETTER.search(text[at[i] : at[i + 1]].decode())) for i in range(hi - lo)])
            if not self.trees:
                langs += [UNKNOWN] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                rates.append(np.full(hi - lo, np.inf))
                continue
            bits = self.code_lengths(buf, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
            langs += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            scores.append(np.where(letters, share, 0.0))
            rates.append(least / size)
        none = [np.zeros(0)]
        return langs, np.concatenate([*none, *scores]), np.concatenate([*none, *rates])


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Grow the trees from up to ``TEXTS_PER_LANGUAGE`` whole texts per language, fold 2 of 4 left out.

    Rows without text, language or id are not learnt from. No row to learn from: a
    model without languages, which calls everything unknown.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    picked = bounded_sample(known.filter(F.octet_length("text") <= MOST_BYTES).select("doc_id", "lang"), ["lang"], "doc_id", TEXTS_PER_LANGUAGE)
    rows = texts_of(known, picked, ["doc_id", "lang"]).select("lang", "text").toArrow()
    by_lang, trees = rows.column("lang").to_pylist(), {}
    for lang in sorted(set(by_lang)):
        column = rows.column("text").filter(pa.array([x == lang for x in by_lang])).combine_chunks()
        keys = [windows(buf, offsets) for _, _, buf, offsets in slices(column)]
        trees[lang] = ContextTree(np.concatenate([np.zeros(0, U), *keys]))
    return Model(trees)


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` for every row of ``docs``.

    Null text or text without a letter is ``und`` with score 0. The score is the
    chosen language's share when every language's probability of the text counts
    alike; equal code lengths go to the language first in order. Repeated rows give repeated results,
    an empty table an empty one; texts are read whole. Other columns are ignored.
    """
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rate = shared.value.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known, columns unchanged: ``und`` goes."""
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _ = shared.value.judge(batch.column("text").cast(pa.string()))
            yield batch.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(spark, docs, train(spark, docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
