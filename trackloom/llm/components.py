"""Connected components of a graph in a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a long, b long): root is the smallest node reachable.

    Alternates two steps until nothing changes: each node passes its smallest neighbour to its larger neighbours, then to
    its smaller ones. Minima are taken by partial aggregation and joined back, so a node of many links is no hot group;
    each round is stored, so a lost executor costs one round. Links that repeat and loops are harmless; an empty table
    gives no rows. Raises after most_rounds; the rounds grow with the logarithm of a component's size.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        old, edges = edges, stored(small.where("u <> v").distinct(), "links")
        discard(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"no end after {most_rounds} rounds")


class Forest:
    """Union-find over 0 .. n-1 within a task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, pairs: np.ndarray) -> np.ndarray:
        """The pairs (k, 2) that joined two trees."""
        new = []
        for i, j in pairs.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                new.append((i, j))
        return np.array(new, np.int64).reshape(-1, 2)
