"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits by a random direction at the median; vectors close to the
boundary go to both sides. The tops of the trees are built on the driver from a
bounded sample and broadcast; they route every distinct vector to its leaves. Each
leaf's task goes on splitting until parts are small and reports the parts of every
vector. With the parts of all trees at hand, leaves are compared part by part in
double precision and add up links. A pair may meet in many parts; it counts only in
the first one that both share, which is where it was first compared, so link counts
need no pair table. Leaves report a spanning forest of their links, which is united
into components.

Exact copies are grouped first and compared once. Below the tops, leaves go on splitting by
directions that all leaves of a tree share, so routed leaves stay small however many vectors
there are. A leaf that stays large all the same (a crowd that no direction parts) is dealt
into blocks, and each pair of blocks is compared in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, table, with_workers, written
from .components import Forest, components

COSINE = 0.95
#: Trees; half width of the overlap at a boundary; vectors in a leaf that are compared directly.
TREES, SPILL, LEAF = 8, 0.02, 256
#: Distinct vectors that a routed leaf aims at, and the most that the driver samples for routing.
ROUTED_ROWS, SAMPLE_ROWS = 2048, 32768
#: Lengths of vectors that get routing tops at most, the commonest ones; all vectors of another length share one leaf a tree.
ROUTED_DIMS = 64
BLOCK = 512
#: A routed leaf of more rows is compared in blocks of about so many.
BIG_LEAF = 1 << 14
#: Bits of a leaf's number within its tree, and of a part's within its leaf; tree, leaf and part make up a part's place.
LEAF_BITS, PART_BITS = 40, 18


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in double precision, and which rows have one; all rows have one dimension.

    Zero vectors and those with null or non-finite components have none.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1).copy() if n else np.zeros((0, 1))
    good = np.isfinite(x).all(axis=1)
    x[~good] = 0
    scale = np.abs(x).max(axis=1, initial=0)
    x /= np.where(scale > 0, scale, 1)[:, None]  # so that squares neither vanish nor overflow
    norm = np.sqrt((x * x).sum(axis=1))
    good &= norm > 0
    return x / np.where(norm > 0, norm, 1)[:, None], good


def _direction(dim: int, rng: np.random.Generator) -> np.ndarray:
    d = rng.standard_normal(dim)
    return d / np.linalg.norm(d)


class Tree:
    """Routing of one tree: nodes ``(direction, boundary, left, right)`` from a sample (a child below 0 is
    leaf ``-child - 1``), then ``deep`` levels whose directions all leaves share, each with its own boundary."""

    def __init__(self, sample: np.ndarray, depth: int, deep: int, seed: int):
        self.nodes: list = []
        self.leaves: list[np.ndarray] = []
        self.rng = np.random.default_rng(seed)
        if len(sample):
            self._grow(sample, depth)
            self.directions = [_direction(sample.shape[1], self.rng) for _ in range(deep)]
            self.cuts = np.array([self._cuts(x) for x in self.leaves])
        else:
            self.directions, self.cuts = [], np.zeros((0, 0))
        self.leaves = []

    def _grow(self, x: np.ndarray, left: int) -> int:
        if left and len(x) >= 32:
            for _ in range(4):
                d = _direction(x.shape[1], self.rng)
                p = x @ d
                cut = float(np.median(p))
                if (p < cut + SPILL).mean() < 0.9 and (p >= cut - SPILL).mean() < 0.9:
                    at = len(self.nodes)
                    self.nodes.append(None)
                    self.nodes[at] = (d, cut, self._grow(x[p < cut + SPILL], left - 1), self._grow(x[p >= cut - SPILL], left - 1))
                    return at
        self.leaves.append(x)
        return -len(self.leaves)

    def _cuts(self, x: np.ndarray) -> list[float]:
        """The boundary of each deep level in a leaf with these sampled rows; none (infinite) where it would not part them."""
        out = []
        for d in self.directions:
            p = x @ d
            cut = float(np.median(p)) if len(p) else 0.0
            out.append(cut if not len(p) or max((p < cut + SPILL).mean(), (p >= cut - SPILL).mean()) < 0.75 else np.inf)
        return out

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves, with both sides where a vector lies close to a boundary."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            if at < 0:
                rows.append(who)
                leaves.append(np.full(len(who), -at - 1, np.int64))
                continue
            d, cut, left, right = self.nodes[at]
            p = x[who] @ d
            todo += [(left, who[p < cut + SPILL]), (right, who[p >= cut - SPILL])]
        row, top = np.concatenate(rows), np.concatenate(leaves)
        leaf = top
        for q, d in enumerate(self.directions):
            p, cut = (x @ d)[row], self.cuts[top, q]
            low, high = p < cut + SPILL, p >= cut - SPILL
            row, top, leaf = (np.concatenate([c[low], c[high]]) for c in (row, top, 2 * leaf))
            leaf[int(low.sum()) :] += 1
        return row, leaf


def _parts(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Small overlapping leaves of a routed leaf; a crowd that no direction parts stays whole."""
    rng = np.random.default_rng(seed)
    out, todo = [], [np.arange(len(x))]
    while todo:
        who = todo.pop()
        if len(who) > LEAF:
            for _ in range(4):
                p = x[who] @ _direction(x.shape[1], rng)
                cut = np.median(p)
                a, b = p < cut + SPILL, p >= cut - SPILL
                if a.mean() < 0.85 and b.mean() < 0.85:
                    todo += [who[a], who[b]]
                    break
            else:
                out.append(who)
        else:
            out.append(who)
    return out


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of longs as rows, padded by -1."""
    n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(n), max(int(n.max(initial=0)), 1)), -1, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def _met_before(places: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Whether rows i and j share a place below ``limit``."""
    out = np.zeros(len(i), bool)
    left = np.arange(len(i))
    for a in range(places.shape[1]):
        p = places[i[left], a]
        live = (p >= 0) & (p < limit)
        left, p = left[live], p[live]  # places rise, so a row without one here has none further on
        if not len(left):
            break
        met = (places[j[left]] == p[:, None]).any(axis=1)
        out[left[met]] = True
        left = left[~met]
    return out


def part_places(x: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the parts of routed leaf ``here``."""
    parts = _parts(x, here)
    return np.concatenate(parts), np.repeat((here << PART_BITS) + np.arange(len(parts)), [len(who) for who in parts])


def _met_in_bulk(places: np.ndarray, kind: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """``_met_before`` by kinds of rows: those with the same places are asked about once."""
    if len(i) < 4096:
        return _met_before(places, i, j, limit)
    pair, back = np.unique(kind[i] * len(first) + kind[j], return_inverse=True)
    return _met_before(places, first[pair // len(first)], first[pair % len(first)], limit)[back]


def leaf_links(x: np.ndarray, size: np.ndarray, places: np.ndarray, here: int, side: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row first compared in this routed leaf (copies counted), and a spanning forest of all links found.

    ``places`` holds each row's places in all trees up to this leaf, rising, padded by -1.
    With ``side``, only rows of different sides are compared.
    """
    _, kind_first, kind = np.unique(places, axis=0, return_index=True, return_inverse=True)
    row, at = np.nonzero(places >> PART_BITS == here)
    part = places[row, at]
    order = np.argsort(part, kind="stable")
    row, part = row[order], part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    count, forest, tree = np.zeros(len(x), np.int64), Forest(len(x)), []
    for place, who in zip(part[first].tolist(), np.split(row, first[1:]), strict=True):
        left, right = (who, who) if side is None else (who[~side[who]], who[side[who]])
        for lo in range(0, len(left), BLOCK):
            a = left[lo : lo + BLOCK]
            for lo2 in range(lo if side is None else 0, len(right), BLOCK):
                b = right[lo2 : lo2 + BLOCK]
                i, j = np.nonzero(x[a] @ x[b].T >= COSINE)
                if side is None and lo == lo2:
                    i, j = i[i < j], j[i < j]
                i, j = a[i], b[j]
                if not len(i):
                    continue
                tree += forest.link_all(i, j)
                new = ~_met_in_bulk(places, kind, kind_first, i, j, place)
                count += np.bincount(i[new], size[j[new]], len(x)).astype(np.int64) + np.bincount(j[new], size[i[new]], len(x)).astype(np.int64)
    return count, tree


def near_vectors(spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``rows``.

    Links join vectors with a cosine of at least 0.95; those found are true links,
    and a few true ones may be missed (see the tests for recall). Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; others
    link with vectors of their own dimension.
    Repeated ids are vectors of their own; a null id forms no smaller component.
    Other columns are ignored; an empty table gives an empty result.
    """
    with_workers(spark)
    # float vectors stay so while they travel
    vector = "array<float>" if rows.select(embedding).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(vector).alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    # +0 and -0 are one value; a class is a distinct vector, told by the SHA-256 of its components
    text = F.concat_ws(",", F.transform(F.col("v").cast("array<double>"), lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e).cast("string")))
    digest = F.when(F.coalesce(usable, F.lit(False)), F.unhex(F.sha2(text, 256)))
    base = written(spark, base.select("vec_id", digest.alias("digest"), "v"), "vectors")
    classes = base.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    # numbers are given once, as the table is written
    classes = written(spark, classes.withColumn("dim", F.size("v")).withColumn("class", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    # vectors of one length are compared with each other; a length with few vectors needs no routing
    dims = classes.groupBy("dim").count().filter(F.col("count") > ROUTED_ROWS).orderBy(F.desc("count"), "dim").limit(ROUTED_DIMS).collect()
    tops = {}
    if dims:
        got = first_by_hash(classes.select("class", "dim", "v"), "class", n, SAMPLE_ROWS).select("dim", "v").toArrow()
        for dim, many in dims:
            sample, good = unit_rows(got.filter(pa.compute.equal(got.column("dim"), dim)).column("v"))
            sample = sample[good]
            levels = max(0, math.ceil(math.log2(many / ROUTED_ROWS)))
            depth = min(levels, max(1, SAMPLE_ROWS // 64).bit_length() - 1)
            tops[dim] = [Tree(sample, depth, min(levels, LEAF_BITS - 2) - depth, t) for t in range(TREES)]
    forest = spark.sparkContext.broadcast(tops)

    plain = Tree(np.zeros((0, 0)), 0, 0, 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pa.compute.unique(batch.column("dim")).to_pylist():
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                x, good = unit_rows(part.column("v"))
                found = [tree.route(x) for tree in forest.value.get(dim, [plain] * TREES)]
                row = np.concatenate([r for r, _ in found])
                leaf = np.concatenate([leaf + (t << LEAF_BITS) for t, (_, leaf) in enumerate(found)])
                row, leaf = row[good[row]], leaf[good[row]]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("dim").take(at), pa.array(leaf), part.column("class").take(at)], ["dim", "leaf", "class"])

    def split(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, _ = unit_rows(group.column("v").combine_chunks())
        row, place = part_places(x, group.column("leaf")[0].as_py())
        return pa.table({"class": group.column("class").take(pa.array(row)), "place": place})

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        here, one, two = (group.column(c)[0].as_py() for c in ("leaf", "one", "two"))
        x, _ = unit_rows(group.column("v").combine_chunks())
        name = group.column("class").to_numpy()
        places = _padded(group.column("places").combine_chunks())
        side = None if one == two else group.column("block").to_numpy() == two
        count, tree = leaf_links(x, group.column("size").to_numpy(), places, here, side)
        some = np.flatnonzero(count)
        a = np.array([u for u, _ in tree], np.int64)
        b = np.array([v for _, v in tree], np.int64)
        none = pa.nulls(len(a), pa.int64())
        return pa.concat_tables([
            pa.table({"a": name[some], "b": pa.nulls(len(some), pa.int64()), "n": count[some]}),
            pa.table({"a": name[a], "b": name[b], "n": none}),
        ])

    dealt = written(spark, classes.select("dim", "class", "v").mapInArrow(deal, "dim int, leaf long, class long"), "dealt")
    # leaves that stay large: fewer than one for each BIG_LEAF rows dealt
    big = dealt.groupBy("dim", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > BIG_LEAF)
    big = F.broadcast(written(spark, big.select("dim", "leaf", F.ceil(F.col("n") / BIG_LEAF).cast("int").alias("blocks")), "big"))
    # written, so that all leaves see the same parts even if a task runs twice
    small = dealt.join(big, ["dim", "leaf"], "left_anti").join(classes.select("class", "v"), "class")
    small = small.select("dim", "leaf", "class", "v").groupBy("dim", "leaf").applyInArrow(split, "class long, place long")
    whole = dealt.join(big, ["dim", "leaf"], "left_semi").select("class", F.shiftleft("leaf", PART_BITS).alias("place"))
    placed = written(spark, small.unionByName(whole), "places")
    placed = placed.groupBy("class").agg(F.sort_array(F.collect_list("place")).alias("places"))  # some tens a class
    leaf_of = lambda p: F.shiftright(p, PART_BITS)
    rows = classes.select("dim", "class", "size", "v").join(placed, "class")
    rows = rows.select("dim", "class", "size", "v", "places", F.explode(F.array_distinct(F.transform("places", leaf_of))).alias("leaf"))
    rows = rows.withColumn("places", F.filter("places", lambda p: leaf_of(p) <= F.col("leaf")))
    # a large leaf's rows lie in one block each and meet every block
    rows = rows.join(big, ["dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("dim", "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "class", "size", "v", "places")
    found = written(spark, rows.groupBy("dim", "leaf", "one", "two").applyInArrow(compare, "a long, b long, n long"), "links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    roots = components(spark, found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
    named = classes.select("digest", "class", "size", "first_id").join(counts, "class", "left").join(roots, "class", "left")
    named = written(spark, named.select("digest", "first_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root").select("digest", "n_links", "least_id")
    lone = base.filter("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = base.filter("digest IS NOT NULL").select("vec_id", "digest").join(named, "digest").select("vec_id", "n_links", F.col("least_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survival of every vector."""
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
