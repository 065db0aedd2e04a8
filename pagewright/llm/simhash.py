"""SimHash fingerprints of word shingles, and exact near pairs by vantage-point trees.

Two 64-bit fingerprints that differ in at most three bits agree up to one bit in
their upper or in their lower half. So two forests are searched, one over each
half, with radius one, and candidates are checked on all 64 bits. Inside a tree a
node splits its fingerprints at the median Hamming distance from a vantage point;
the near side also takes the shell just beyond the boundary, as wide as the
radius, so every close pair meets in some leaf (triangle inequality).

The top of each tree is built on the driver from a bounded sample, goes on below that by shared vantage points, and only routes:
each distinct fingerprint goes to its own shard and to those whose boundary it
overlaps. The tree goes on growing inside each shard's task, until leaves are
small enough to compare directly. A shard reports a spanning forest of its links,
never all pairs, so dense groups stay linear in what they send.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, slices, table, with_workers, written
from .components import Forest, components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that a shard aims at, and the least and the most that the driver samples for routing.
#: A tree gets a level for each doubling of shards. Up to 2^14 shards its sample (8 MB at most) gets 64 rows a shard;
#: levels below that have vantage points in common, and boundaries from the same sample.
SHARD_ROWS, LEAST_SAMPLE, MOST_SAMPLE = 4096, 1 << 16, 1 << 20
#: A leaf of at most so many is compared directly.
LEAF = 384


def fingerprint_text(raw: bytes) -> int:
    """The fingerprint of one text's UTF-8 bytes."""
    parts = raw.lower().split()  # bytes: only A-Z change, only the six ASCII blanks split
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = [0, *(stops[: n - SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = np.array(hashes[lo : lo + 65536], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for lo, hi, buf, offsets in slices(batch.column("text")):
            whole, at = buf.tobytes(), offsets.tolist()
            for i in range(hi - lo):
                out[lo + i] = fingerprint_text(whole[at[i] : at[i + 1]])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; fp is the fingerprint as a signed long.

    Lower-cased (A-Z) words, three-word shingles with repeats, XXH64 with seed 42;
    a bit is set if more than half the hashes set it. Fewer than three words: the
    whole sequence is the only shingle. No words, null or empty text: zero.
    Columns other than doc_id and text are ignored.
    """
    with_workers(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


# ---- routing ---------------------------------------------------------------


def _half(fp: np.ndarray, side: int) -> np.ndarray:
    return (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)


def _split(half: np.ndarray, full: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, int, bool] | None:
    """Distances from a vantage point, and the boundary: by the half, else by all 64 bits."""
    for use, radius, whole in ((half, 1, False), (full, RADIUS, True)):
        point = use[(turn * 7919) % len(use)]
        d = np.bitwise_count(use ^ point)
        mu = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        near, far = d <= mu + radius, d > mu
        if near.sum() < 0.9 * len(d) and far.any():
            return near, far, mu, whole
    return None


class Tree:
    """Routing of one half: nodes ``(vantage point, boundary, near child, far child)`` from a sample (a child below 0
    is shard ``-child - 1``), then ``deep`` levels whose vantage points all shards share, each with its own boundary."""

    def __init__(self, sample: np.ndarray, side: int, depth: int, deep: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards: list[np.ndarray] = []
        half = _half(sample, side)
        self.points: list[np.uint64] = []
        self.cuts = np.zeros((0, 0), np.int64)
        if depth and len(half):
            self._grow(half, depth, 1)
            self.points = [half[(k * 7919 + 13) % len(half)] for k in range(deep)]
            self.cuts = np.array([self._cuts(rows) for rows in self.shards], np.int64)
        self.shards = []

    def _grow(self, rows: np.ndarray, left: int, turn: int) -> int:
        if left and len(rows) >= 32:
            for attempt in range(4):
                point = int(rows[(turn * 7919 + attempt * 104729) % len(rows)])
                d = np.bitwise_count(rows ^ np.uint64(point))
                mu = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
                near, far = d <= mu + 1, d > mu
                if near.sum() < 0.9 * len(d) and far.any():
                    at = len(self.nodes)
                    self.nodes.append((0, 0, 0, 0))
                    self.nodes[at] = (point, mu, self._grow(rows[near], left - 1, 2 * turn + 1), self._grow(rows[far], left - 1, 2 * turn + 2))
                    return at
        self.shards.append(rows)
        return -len(self.shards)

    def _cuts(self, rows: np.ndarray) -> list[int]:
        """The boundary of each deep level in a shard with these sampled rows; 64, which all are near to, where it would not part them."""
        out = []
        for point in self.points:
            d = np.sort(np.bitwise_count(rows ^ point)).astype(np.int64)
            mu = int(d[(len(d) - 1) // 2]) if len(d) else 16
            out.append(mu if not len(d) or (d <= mu + 1).mean() < 0.9 else 64)
        return out

    def route(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and shards: each row's own shard and those whose boundary it overlaps."""
        rows, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0 if self.nodes else -1, np.arange(len(half)))]
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            if at < 0:
                rows.append(who)
                shards.append(np.full(len(who), -at - 1, np.int64))
                continue
            point, mu, near, far = self.nodes[at]
            d = np.bitwise_count(half[who] ^ np.uint64(point))
            todo += [(near, who[d <= mu + 1]), (far, who[d > mu])]
        row, top = np.concatenate(rows), np.concatenate(shards)
        shard = top
        for q, point in enumerate(self.points):
            d, mu = np.bitwise_count(half ^ point)[row], self.cuts[top, q]
            near, far = d <= mu + 1, d > mu
            row, top, shard = (np.concatenate([c[near], c[far]]) for c in (row, top, 2 * shard))
            shard[int(near.sum()) :] += 1
        return row, shard


# ---- inside a shard ----------------------------------------------------------


def _crowd(full: np.ndarray, ids: np.ndarray, forest: Forest, out: list[tuple[int, int]]) -> None:
    """Exact links of rows that no vantage point parts: breadth first, each row leaves the rest once reached."""
    rest = np.arange(len(full))
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            hit = np.bitwise_count(full[rest] ^ full[u]) <= RADIUS
            if hit.any():
                found = rest[hit]
                for v in found.tolist():
                    if forest.link(int(ids[u]), int(ids[v])):
                        out.append((int(ids[u]), int(ids[v])))
                frontier += found.tolist()
                rest = rest[~hit]


def near_links(full: np.ndarray, side: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (Hamming distance at most 3) whose halves differ by at most one bit."""
    forest, out = Forest(len(full)), []
    todo = [(np.arange(len(full)), 1)]
    while todo:
        ids, turn = todo.pop()
        if len(ids) < 2:
            continue
        rows = full[ids]
        if len(ids) <= LEAF:
            i, j = np.nonzero(np.triu(np.bitwise_count(rows[:, None] ^ rows[None, :]) <= RADIUS, 1))
            out += forest.link_all(ids[i], ids[j])
            continue
        parts = _split(_half(rows, side), rows, turn)
        if parts is None:
            _crowd(rows, ids, forest, out)
        else:
            todo += [(ids[parts[0]], 2 * turn + 1), (ids[parts[1]], 2 * turn + 2)]
    return out


def links(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """``(a, b)``: links between different fingerprints that connect all that are within three bits."""
    n = distinct.count()
    shards = max(1, -(-n // SHARD_ROWS))
    levels = (shards - 1).bit_length()
    depth = min(levels, max(0, (MOST_SAMPLE // 64 - 1).bit_length()))
    sample = np.zeros(0, np.uint64)
    if depth:
        got = first_by_hash(distinct.select("fp"), "fp", n, max(LEAST_SAMPLE, 64 << depth)).toArrow()
        sample = got.column("fp").to_numpy().view(np.uint64)
    trees = [Tree(sample, side, depth, levels - depth) for side in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                rows, shard = trees[side].route(_half(fp, side))
                yield pa.RecordBatch.from_arrays([pa.array(shard * 2 + side), pa.array(fp[rows].view(np.int64))], ["shard", "fp"])

    def find(group: pa.Table) -> pa.Table:
        side = int(group.column("shard")[0].as_py()) & 1
        full = group.column("fp").to_numpy().view(np.uint64)
        pairs = np.array(near_links(full, side), np.int64).reshape(-1, 2)
        return pa.table({"a": full[pairs[:, 0]].view(np.int64), "b": full[pairs[:, 1]].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(find, "a long, b long")


def groups_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``(fp, root)`` of every fingerprint in ``rows``: equal roots are one group."""
    distinct = written(spark, rows.select("fp").distinct(), "distinct")
    # written before anything else reads it: a shard's forest follows the order in which its rows arrive, so a second run may report another
    found = written(spark, links(spark, distinct), "links")
    roots = components(spark, found).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    component_id is the least doc_id among all documents reachable over links of
    three or fewer bits, itself included; null ids do not count, so it is null only
    where a group has no other. Equal fingerprints (those of texts without words
    among them) are one group. An empty table gives an empty result.
    """
    rows = written(spark, fingerprints(spark, docs), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = written(spark, groups_of(spark, rows).join(first, "fp"), "groups")
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = groups.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (16 lower-case hex digits) and group of every document."""
    found = near_groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one left of each near-duplicate group, its columns unchanged.

    The row with the least doc_id stays, and of rows that repeat it just one; a
    null id stays only where a group has no other. Texts are written once with
    their fingerprints and shuffled once to drop the others.
    """
    with_workers(spark)
    columns, tag = docs.columns, uuid.uuid4().hex[:8]
    uid, fp = f"uid_{tag}", f"fp_{tag}"
    schema = T.StructType([*docs.schema.fields, T.StructField(uid, T.LongType()), T.StructField(fp, T.LongType())])

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = _fingerprint_batches(iter([batch.select(["doc_id", "text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found.column("fp")], [*batch.schema.names, fp])

    tagged = written(spark, docs.withColumn(uid, F.monotonically_increasing_id()).mapInArrow(append, schema), "tagged")
    rows = tagged.select("doc_id", F.col(uid).alias("uid"), F.col(fp).alias("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    first = written(spark, rows.groupBy("fp").agg(F.min(order).alias("first")), "first")
    kept = first.join(groups_of(spark, rows), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return tagged.join(kept.select(F.col("first.u").alias(uid)), uid, "left_semi").select(*columns)
