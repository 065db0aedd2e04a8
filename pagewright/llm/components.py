"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, written


class Forest:
    """Union-find over small integers, for links found inside one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


    def link_all(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Link all pairs; returns those that joined two trees."""
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        a, b = self.up[i], self.up[j]
        apart = np.flatnonzero(a != b)
        _, first = np.unique(np.stack([a[apart], b[apart]]), axis=1, return_index=True)
        apart = apart[first]
        return [(u, v) for u, v in zip(i[apart].tolist(), j[apart].tolist(), strict=True) if self.link(u, v)]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs to ``(node, root)``: root is the least node reachable.

    Every round hooks each node to the least label beside it and then jumps to
    that label's own label, so the number of rounds grows with the logarithm of
    the longest chain. Rounds are written to the shared folder and deleted once the next is;
    nothing but one row count reaches the driver. Nodes without an edge are absent; an empty
    edge table gives an empty result; null ends are ignored. ``edges`` is read more than once and must be the
    same each time, so it must be a written table if the order of rows can change it.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    pairs = written(spark, pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct(), "edges")
    label = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    label = written(spark, label, "labels")
    while True:
        beside = pairs.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = label.join(beside, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("near"))
        far = label.select(F.col("node").alias("near"), F.col("root").alias("jump"))
        step = hooked.join(far, "near").select("node", "old", F.least("near", "jump").alias("root"))
        step, before = written(spark, step, "labels"), label
        label = step.select("node", "root")
        dropped(spark, before)
        if not step.filter("old <> root").limit(1).count():
            dropped(spark, pairs)
            return label
