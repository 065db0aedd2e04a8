"""Byte-level BPE in DuckDB, one embedded engine per worker process.

Texts are cut by the public pattern (``pretok``); each distinct piece becomes rows
(word, position, token). A recursive query joins neighbouring tokens with the
merge table and contracts, in every word at once, the leftmost pair of least
rank, until no pair merges. Decoding joins tokens with their bytes and puts those
together again by an ordered aggregation. Pieces go in as bounded blocks, so the
engine's memory does not follow the partition.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, with_workers
from .pretok import PieceIds

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pieces, by their bytes, that one recursive query takes.
BLOCK_BYTES = 1 << 19
ENGINE_MEMORY = "300MB"
#: Texts that the query cuts into pieces at a time.
SLICE_BYTES = 1 << 21

#: A row is a token with the next token of its word beside it. Each round ranks the pairs,
#: takes the least rank and position of every word, and contracts that pair: the left row takes
#: over what stands beyond the right row, the row before sees the new token, the right row goes.
#: Words without a pair that merges leave the recursion.
ENCODE_SQL = """
WITH RECURSIVE step(word, pos, id, next_id, next_pos, live) AS (
    SELECT word, pos, id, next_id, CASE WHEN next_id IS NOT NULL THEN pos + 1 END, true FROM base
  UNION ALL
    (WITH ranked AS (
        SELECT s.word, s.pos, s.id, s.next_id, s.next_pos, (m.id::BIGINT << 32) | s.pos AS pair
        FROM step s LEFT JOIN merges m ON m.l = s.id AND m.r = s.next_id WHERE s.live
    ), least AS (
        SELECT word, min(pair) AS pair FROM ranked GROUP BY word
    ), chosen AS (
        SELECT r.word, r.pos, r.id, r.next_id, r.next_pos, (l.pair >> 32)::INTEGER AS merged, l.pair & 4294967295 AS at
        FROM ranked r JOIN least l ON l.word = r.word
    ), gone AS (
        SELECT r.word, r.pos, r.next_id, r.next_pos
        FROM chosen c JOIN ranked r ON r.word = c.word AND r.pos = c.next_pos WHERE c.pos = c.at
    )
    SELECT c.word, c.pos, CASE WHEN c.pos = c.at THEN c.merged ELSE c.id END,
           CASE WHEN c.pos = c.at THEN g.next_id WHEN c.next_pos = c.at THEN c.merged ELSE c.next_id END,
           CASE WHEN c.pos = c.at THEN g.next_pos ELSE c.next_pos END, c.at IS NOT NULL
    FROM chosen c LEFT JOIN gone g ON g.word = c.word
    WHERE g.pos IS NULL OR c.pos <> g.pos)
)
SELECT word, id FROM step WHERE NOT live ORDER BY word, pos
"""

#: The same for very long words, whose leftmost least pairs would take one round each: a round
#: contracts all pairs of the least rank, in a chain of overlapping ones every other from the left.
#: A contraction never makes a pair of lower rank, so the result is that of one at a time.
LONG_SQL = """
WITH RECURSIVE step(word, pos, id, live) AS (
    SELECT word, pos, id, true FROM base
  UNION ALL
    SELECT word, pos, CASE WHEN take THEN least ELSE id END, least IS NOT NULL
    FROM (
        SELECT word, pos, id, least, take, lag(take, 1, false) OVER line AS gone
        FROM (
            SELECT word, pos, id, least, hit AND row_number() OVER (PARTITION BY word, hit, place - hits ORDER BY pos) % 2 = 1 AS take
            FROM (
                SELECT *, row_number() OVER line AS place, sum(hit::INTEGER) OVER line AS hits
                FROM (
                    SELECT *, min(rank) OVER (PARTITION BY word) AS least, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS hit
                    FROM (
                        SELECT a.word, a.pos, a.id, m.id AS rank
                        FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS beside FROM step WHERE live) a
                        LEFT JOIN merges m ON m.l = a.id AND m.r = a.beside
                    )
                ) WINDOW line AS (PARTITION BY word ORDER BY pos)
            )
        ) WINDOW line AS (PARTITION BY word ORDER BY pos)
    )
    WHERE NOT gone
)
SELECT word, id FROM step WHERE NOT live ORDER BY word, pos
"""
#: Words of more bytes than this are long.
LONG_BYTES = 48

DECODE_SQL = """
SELECT t.word, from_hex(string_agg(v.hex, '' ORDER BY t.pos)) AS raw
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.word ORDER BY t.word
"""

_engines: dict[str, Engine] = {}


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Engine:
    """Merge table, vocabulary and the two queries, in one in-memory database."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        l, r, i = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": ENGINE_MEMORY, "temp_directory": tempfile.gettempdir()})
        self._load("m", pa.table({"l": l, "r": r, "id": i}), "CREATE TABLE merges AS SELECT * FROM m")
        words = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self._load("v", words, "CREATE TABLE vocabulary AS SELECT * FROM v")

    def _load(self, name: str, rows: pa.Table, sql: str) -> pa.Table | None:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table() if sql.lstrip().startswith(("SELECT", "WITH")) else self.con.execute(sql) and None
        finally:
            self.con.unregister(name)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG_BYTES]
        if not long:
            return self._encode(pieces, ENCODE_SQL)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG_BYTES]
        parts = [(which, *self._encode([pieces[i] for i in which], sql)) for which, sql in ((short, ENCODE_SQL), (long, LONG_SQL))]
        sizes = np.zeros(len(pieces), np.int64)
        for which, _, n in parts:
            sizes[which] = n
        ends = np.cumsum(sizes)
        ids = np.zeros(int(ends[-1]), np.int32)
        for which, got, n in parts:
            first = (ends - sizes)[which]
            ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return ids, sizes

    def _encode(self, pieces: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        ids, counts, lo = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
            raw = np.frombuffer(b"".join(pieces[lo:hi]), np.uint8)
            n = sizes[lo:hi]
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
            word, id_ = np.repeat(np.arange(hi - lo, dtype=np.int32), n), self.byte_id[raw]
            last = np.append(word[1:] != word[:-1], True)
            beside = pa.array(np.append(id_[1:], 0).astype(np.int32), mask=last)
            base = pa.table({"word": word, "pos": pos.astype(np.int32), "id": id_, "next_id": beside})
            got = self._load("base", base, sql)
            ids.append(got.column("id").to_numpy())
            counts.append(np.bincount(got.column("word").to_numpy(), minlength=hi - lo))
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all runs of ids one after the other, and how many each has."""
        raw, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            first = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, first + BLOCK_BYTES, "right")))
            n = sizes[lo:hi]
            pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.table({"word": np.repeat(np.arange(hi - lo, dtype=np.int32), n), "pos": pos.astype(np.int32), "id": ids[first : ends[hi - 1]].astype(np.int32)})
            got = self._load("tokens", rows, DECODE_SQL)
            cells = got.column("raw").combine_chunks()
            cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
            at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
            raw.append(np.frombuffer(cells.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] else np.zeros(0, np.uint8))
            own = np.zeros(hi - lo, np.int64)
            own[got.column("word").to_numpy()] = np.diff(at)
            counts.append(own)
            lo = hi
        return np.concatenate(raw), np.concatenate(counts)


def engine(path: str) -> tuple[Engine, PieceIds]:
    if path not in _engines:
        e = Engine(path)
        _engines[path] = e, PieceIds(e.encode, e.decode)
    return _engines[path]


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs``; null text counts as empty and has no ids.

    No special tokens: their strings count as ordinary text.
    """
    path = path or ranks_path()
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("text")):
                ids, at = engine(path)[1].encode_rows(buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, raw binary)`` from ``(doc_id, ids)``; null and empty ids give empty bytes."""
    path = path or ranks_path()
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c or [] for c in batch.column("ids").to_pylist()]
            sizes = np.fromiter(map(len, cells), np.int64, len(cells))
            ids = np.fromiter((i for c in cells for i in c), np.int32, int(sizes.sum()))
            raw, n = engine(path)[0].decode(ids, sizes)
            at = np.concatenate([[0], np.cumsum(n)]).tolist()
            whole = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([whole[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "raw"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes they decode to, for every document.

    Null text counts as empty. Repeated rows give repeated results.
    """
    path = ranks_path()
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = engine(path)[1]
            for lo, hi, buf, offsets in slices(batch.column("text"), SLICE_BYTES):
                slot, upto = coder.slots(buf, offsets)
                ids, id_at = coder.ids.gather(slot)
                raw, raw_at = coder.raw.gather(slot)
                id_at, raw_at = id_at[upto], raw_at[upto]
                ids, raw = memoryview(ids.astype("<u4")).cast("B"), memoryview(raw)
                sha = lambda view, at: [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                out = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(id_at)), pa.array(sha(ids, (4 * id_at).tolist()), pa.string()), pa.array(sha(raw, raw_at.tolist()), pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
