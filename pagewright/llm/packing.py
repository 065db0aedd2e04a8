"""Concatenate and cut: token ids of all documents in one stream, cut into fixed windows.

The first pass tokenizes each text once and writes its ids with the number of
tokens before it in its partition. Partition totals (one number each) become
partition offsets by a prefix sum, so each document knows its place in the whole
stream without a sort or a shuffle. The second pass cuts each document at window
borders; a document that crosses borders yields one record per window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, with_workers, written
from .pretok import PieceIds

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"

_coders: dict[str, Coder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Ids by a vocabulary file of the `tokenizers` library.

    The file's merges stand in the order of their ids, so merging by least id is
    the same as merging in file order; the tests compare with the library itself.
    As there, the file's added strings (``<|endoftext|>``) are one id wherever they
    stand in a text, and the text on either side is cut into pieces on its own.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sign = byte_symbols()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added strings with conditions on their surroundings are not supported")
        ranks = {bytes(sign[x] for x in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        one = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            got = [one(x.decode()) for x in new]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

        self.pieces = PieceIds(encode)
        self.added = {x.encode(): i for x, i in added.items()}
        self.find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

    def encode_rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin (one more at the end)."""
        raw, found = buf.tobytes(), []
        if self.find and any(x in raw for x in self.added):
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                found += [(m.start(), m.end(), self.added[m[0]]) for m in self.find.finditer(raw, a, b)]
        if not found:
            return self.pieces.encode_rows(buf, offsets)
        start, end, ids = np.array(found, np.int64).T
        cuts = np.unique(np.concatenate([offsets, start, end]))
        got, at = self.pieces.encode_rows(buf, cuts)
        n, special = np.diff(at), np.searchsorted(cuts, start)
        own = np.ones(len(n), bool)
        own[special] = False
        sizes = np.where(own, n, 1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(bounds[-1]), np.int32)
        out[np.repeat(own, sizes)] = got[np.repeat(own, n)]
        out[bounds[special]] = ids
        return out, bounds[np.searchsorted(cuts, offsets)]


def coder(path: str) -> Coder:
    """One coder per worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenized(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(part, before, doc_id, n, ids)``: little-endian unsigned 32-bit ids of each text, the end id last.

    ``before`` counts the tokens ahead of the document in its partition; null text
    counts as empty and is the end id alone. Written to the shared folder.
    """
    path = path or vocabulary_path()
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ids_of = coder(path)
            for lo, hi, buf, offsets in slices(batch.column("text")):
                ids, at = ids_of.encode_rows(buf, offsets)
                n = np.diff(at) + 1
                flat = np.full(int(n.sum()), END_ID, "<u4")
                ends = np.cumsum(n)
                own = np.ones(len(flat), bool)
                own[ends - 1] = False
                flat[own] = ids
                raw = pa.py_buffer(flat.tobytes())
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32).tobytes()), raw])
                starts = before + ends - n
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(lo, hi - lo), pa.array(starts), batch.column("doc_id").slice(lo, hi - lo), pa.array(n), binary], ["part", "before", "doc_id", "n", "ids"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(spark, rows.mapInArrow(run, "part int, before long, doc_id long, n long, ids binary"), "tokens")


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for.

    Sequence k holds tokens k*window to (k+1)*window - 1 of the stream, so every
    sequence but the last is full. Repeated and null doc_ids are documents like
    any other. An empty table gives an empty result; columns other than doc_id and
    text are ignored.
    """
    rows = tokenized(spark, docs, path)
    totals = sorted((r["part"], r["total"]) for r in rows.groupBy("part").agg(F.sum("n").alias("total")).collect())  # one number per partition
    base, at = {}, 0
    for part, total in totals:
        base[part] = at
        at += total
    bases = spark.sparkContext.broadcast(base)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            column = {name: batch.column(name).to_pylist() for name in ("part", "before", "doc_id", "n")}
            for part, before, doc, n, cell in zip(*column.values(), batch.column("ids"), strict=True):
                raw, place = memoryview(cell.as_buffer()), bases.value[part] + before
                done = 0
                while done < n:
                    sequence, offset = divmod(place + done, window)
                    take = min(n - done, window - offset)
                    ids = raw[4 * done : 4 * (done + take)]
                    for values, x in zip(out, (doc, done, take, zlib.crc32(ids), n, sequence, offset), strict=False):
                        values.append(x)
                    if with_ids:
                        out[-1].append(bytes(ids))
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if name == "ids" else pa.int64()) for v, name in zip(out, names, strict=True)], names)

    return rows.mapInArrow(cut, ", ".join(f"{name} {'binary' if name == 'ids' else 'long'}" for name in names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies, with a checksum of its ids."""
    return pack(spark, table(spark, sf_dir, "documents"), with_ids=False)
