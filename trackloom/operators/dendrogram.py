"""Average-linkage trees of features: merges by a nearest-neighbour chain, leaf order and cuts from the merge table.

Correlations are sums over the rows (prepare.correlations); only the features squared reach the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .prepare import correlations


class Merge(NamedTuple):
    """Clusters joined: leaves are 0 to n - 1, the merge in row i makes cluster n + i."""

    left: int
    right: int
    height: float
    size: int


def merges(distance: np.ndarray) -> list[Merge]:
    """The merge table, lowest first, of average linkage over a symmetric matrix of distances.

    A chain steps to the nearest cluster until two are nearest to each other, which average linkage may join at once, so
    the whole takes a time square in the leaves. Of equal distances the cluster before in the chain comes first, then
    the one of the least leaf; so equal distances have one defined tree.
    """
    d = np.array(distance, float)
    n = len(d)
    if d.shape != (n, n) or not np.allclose(d, d.T, equal_nan=True):
        raise ValueError("a symmetric matrix is needed")
    if not np.isfinite(d).all():
        raise ValueError("a distance is missing")
    np.fill_diagonal(d, np.inf)
    size, alive, chain = np.ones(n), np.ones(n, bool), []
    joined: list[tuple[float, int, int]] = []
    while len(joined) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        here = chain[-1]
        near = int(d[here].argmin())
        if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
            near = chain[-2]
            del chain[-2:]
            keep, gone = min(here, near), max(here, near)
            joined.append((float(d[keep, gone]), keep, gone))
            row = (d[keep] * size[keep] + d[gone] * size[gone]) / (size[keep] + size[gone])
            size[keep] += size[gone]
            alive[gone] = False
            d[keep], d[:, keep] = row, row
            d[gone], d[:, gone] = np.inf, np.inf
            d[keep, keep] = np.inf
        else:
            chain.append(near)
    # The chain finds merges out of order; each is named by a leaf of either side, and sorting keeps a child before its parent.
    order = sorted(range(n - 1), key=lambda i: (joined[i][0], i))
    owner, name, count, out = list(range(n)), list(range(n)), [1] * n, []

    def root(leaf: int) -> int:
        while owner[leaf] != leaf:
            owner[leaf] = owner[owner[leaf]]
            leaf = owner[leaf]
        return leaf

    for i in order:
        height, a, b = joined[i]
        a, b = root(a), root(b)
        owner[b] = a
        count[a] += count[b]
        out.append(Merge(min(name[a], name[b]), max(name[a], name[b]), height, count[a]))
        name[a] = n + len(out) - 1
    return out


def leaf_order(table: list[Merge]) -> list[int]:
    """Leaves from left to right; of a merge the cluster of the smaller number stands left."""
    n = len(table) + 1
    order, waiting = [], [2 * n - 2]
    while waiting:
        k = waiting.pop()
        if k < n:
            order.append(k)
        else:
            waiting += [table[k - n].right, table[k - n].left]
    return order


def cut(table: list[Merge], height: float) -> list[int]:
    """Of each leaf its cluster among the merges up to that height, numbered by the least leaf from 0."""
    n = len(table) + 1
    least = list(range(n))
    owner = list(range(2 * n - 1))
    for i, m in enumerate(table):
        if m.height <= height:
            owner[m.left] = owner[m.right] = n + i

    def top(k: int) -> int:
        while owner[k] != k:
            k = owner[k]
        return k

    tops = [top(k) for k in least]
    number = {t: i for i, t in enumerate(dict.fromkeys(tops))}
    return [number[t] for t in tops]


def of_features(table: DataFrame, features: list[str], threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The tree of features at distance 1 - |r| (1 where r is undefined): its merges (step, left_node, right_node, height,
    size), and of each feature its place in the leaf order and its cluster at the cut 1 - threshold."""
    spark, at = table.sparkSession, {c: i for i, c in enumerate(features)}
    d = np.zeros((len(features), len(features)))
    for r in correlations(table, features).collect() if len(features) > 1 else []:
        i, j = at[r["a"]], at[r["b"]]
        d[i, j] = d[j, i] = 1 - abs(min(1.0, max(-1.0, r["r"] or 0.0)))
    tree = merges(d)
    place = {leaf: k for k, leaf in enumerate(leaf_order(tree))}
    steps = [(i, m.left, m.right, m.height, m.size) for i, m in enumerate(tree)]
    leaves = [(c, place[i], k) for i, (c, k) in enumerate(zip(features, cut(tree, 1 - threshold), strict=True))]
    return spark.createDataFrame(steps, "step int, left_node int, right_node int, height double, size int"), spark.createDataFrame(leaves, "feature string, place int, cluster int")
