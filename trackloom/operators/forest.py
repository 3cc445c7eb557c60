"""Random forests over rows of any number, and permutation importance of features on held-out folds.

`forest` is Spark ML's: trees grow level by level from histograms of (tree, node, feature, bin), of which each partition makes
one for every node, however few rows it has. `importance` grows many deep trees, most of whose nodes are small: its large
nodes are split that way, and the rows of a small node come together once and grow what is below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crossval import fold_plan
from .ordination import configured, summed

TREES, DEPTH, REPEATS = 250, 10, 5


def labelled(rows: DataFrame, group: str, vector: str, groups: list[str]) -> DataFrame:
    """rows with label, the group's number, and features, as Spark ML takes them."""
    number = F.array_position(F.array(*map(F.lit, groups)), F.col(group).cast("string")) - 1
    return rows.withColumns({"label": number.cast("double"), "features": array_to_vector(F.col(vector).cast("array<double>"))})


def forest(rows: DataFrame, group: str, vector: str, groups: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> RandomForestClassificationModel:
    """A forest whose rows weigh inversely to their group's size. groups: the groups' names, by their numbers."""
    rows = labelled(rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()), group, vector, groups)
    n = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.element_at(F.array(*[F.lit(sum(n.values()) / (len(n) * n.get(i, 1))) for i in range(len(groups))]), F.col("label").cast("int") + 1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, weightCol="weight", cacheNodeIds=depth > 10).fit(rows.select("label", "features", weight.alias("weight")))


#: Bins of a feature, from quantiles of SAMPLE rows; rows of a node up to which a task grows all that is below it; trees that a
#: task counts for at a time; groups of blocks by which it does so; rows of a block, within which values are permuted.
BINS, SAMPLE, SMALL, SLICE, GROUPS, BLOCK = 32, 10_000, 16_384, 50, 8, 500


def best_splits(hist: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the feature (its place among those tried) and bin whose split lowers weighted Gini impurity most, the
    counts that go left, and whether there is such a split. hist: counts by node, feature, bin, class."""
    left = np.cumsum(hist, 2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    a, b = left * weights, (whole - left) * weights
    wa, wb = a.sum(3), b.sum(3)
    there = (wa > 0) & (wb > 0)
    gain = np.where(there, (a * a).sum(3) / np.where(there, wa, 1) + (b * b).sum(3) / np.where(there, wb, 1), -np.inf).reshape(len(hist), -1)
    at = gain.argmax(1)
    k, bins = np.arange(len(hist)), left.shape[2]
    all_ = whole[:, 0, 0] * weights
    fine = gain[k, at] > (all_ * all_).sum(1) / np.maximum(all_.sum(1), 1e-300) * (1 + 1e-9)
    return at // bins, at % bins, left[k, at // bins, at % bins], fine


def tried(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """The features that a node may split by: as many as the root of their number."""
    return np.random.default_rng([seed, 1, tree, node]).permutation(features)[: math.ceil(math.sqrt(features))]


def counts_by_bin(codes: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, picks: np.ndarray, classes: int) -> np.ndarray:
    """Counts by node, tried feature, bin and class. at: each row's node, a row of picks."""
    nodes, wide = picks.shape
    code = np.take_along_axis(codes, picks[at], 1).astype(np.int64)
    where = ((at[:, None] * wide + np.arange(wide)) * BINS + code) * classes + y[:, None]
    return np.bincount(where.ravel(), np.repeat(n, wide), nodes * wide * BINS * classes).reshape(nodes, wide, BINS, classes)


def below(codes: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray, seed: int, tree: int, root: int, depth: int) -> list[tuple[np.ndarray, ...]]:
    """The nodes from root on (a node's children are 2 node and 2 node + 1), level by level: (node, feature or -1, bin,
    classes' shares). n: how often each row counts."""
    classes, out, at, nodes = len(weights), [], np.zeros(len(y), np.int64), np.array([root])
    while len(nodes):
        count = np.bincount(at * classes + y, n, len(nodes) * classes).reshape(-1, classes)
        share = count * weights
        share = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
        feature, bin_ = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        may = np.flatnonzero((count > 0).sum(1) > 1) if int(nodes[0]).bit_length() <= depth else np.zeros(0, np.int64)
        if len(may):
            place = np.full(len(nodes), -1)
            place[may] = np.arange(len(may))
            keep = place[at] >= 0
            codes, y, n, at = codes[keep], y[keep], n[keep], at[keep]
            picks = np.stack([tried(seed, tree, k, codes.shape[1]) for k in nodes[may].tolist()])
            slot, b, _, fine = best_splits(counts_by_bin(codes, y, n, place[at], picks, classes), weights)
            feature[may] = np.where(fine, picks[np.arange(len(may)), slot], -1)
            bin_[may] = b
        out.append((nodes, feature, bin_, share))
        split = np.flatnonzero(feature >= 0)
        place = np.full(len(nodes), -1)
        place[split] = 2 * np.arange(len(split))
        keep = place[at] >= 0
        codes, y, n, at = codes[keep], y[keep], n[keep], at[keep]
        at = place[at] + (codes[np.arange(len(at)), feature[at]] > bin_[at])
        nodes = np.repeat(2 * nodes[split], 2) + np.tile([0, 1], len(split))
    return out


class Tree:
    """A tree's nodes by number; reached() goes down from the first."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        node, self.feature, self.bin, self.share = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(node)
        node, self.feature, self.bin, self.share = node[order], self.feature[order].astype(np.int16), self.bin[order].astype(np.uint8), self.share[order].astype(np.float32)
        self.left = np.where(self.feature >= 0, np.searchsorted(node, 2 * node), 0).astype(np.int32)
        self.number = node

    def reached(self, code, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows that go on, the features they are asked for, where all rows are): a step at a time. code(rows, features)."""
        at = np.zeros(rows, np.int64)
        live = np.arange(rows)
        while True:
            f = self.feature[at[live]]
            live, f = live[f >= 0], f[f >= 0]
            yield live, f, at
            if not len(live):
                return
            k = at[live]
            at[live] = self.left[k] + (code(live, f) > self.bin[k])


def binned(rows: DataFrame, cuts: np.ndarray, groups: list[str], folds: dict[int, int]) -> DataFrame:
    """(block, fold, m, y, codes) checkpointed: rows (key, g, v, fold) by random blocks of a fold, in the order of key; the
    bins of their values and the numbers of their groups as bytes. folds: rows of each fold."""
    configured(rows.sparkSession)
    blocks = F.element_at(F.create_map(*[F.lit(x) for f, n in folds.items() for x in (f, max(1, -(-n // BLOCK)))]), F.col("fold"))
    number = {g: i for i, g in enumerate(groups)}

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        v = np.array(t["v"].to_pylist(), float)
        codes = np.stack([np.searchsorted(c, x) for c, x in zip(cuts, v.T, strict=True)], 1).astype(np.uint8)
        y = np.array([number[g] for g in t["g"].to_pylist()], np.int32)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "fold": pa.array([t["fold"][0].as_py()], pa.int32()), "y": pa.array([y.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

    return rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).groupBy("fold", "block").applyInArrow(pack, "block int, fold int, y binary, codes binary").checkpoint()


def forests(packs: DataFrame, weights: dict[int, np.ndarray], rows: dict[int, int], features: int, trees: int, depth: int, seed: int) -> dict[int, list[Tree]]:
    """Of each fold a forest grown on the other folds' rows, all forests together. weights: of the groups, by fold; rows: how
    many rows a fold's forest has.

    A row counts in a tree as often as a Poisson draw of mean one says. Nodes of over SMALL rows are split from counts by bin
    that tasks return, all trees' nodes of a level in one pass; then the rows of each smaller node come together, and what is
    below it is grown where they are.
    """
    spark = packs.sparkSession
    wide, classes = int(spark.conf.get("spark.sql.shuffle.partitions")), len(next(iter(weights.values())))
    slices = [(f, i, min(i + SLICE, trees)) for f in sorted(weights) for i in range(0, trees, SLICE)]
    order = {f: k for k, f in enumerate(sorted(weights))}
    group = F.pmod(F.xxhash64("fold", "block"), F.lit(GROUPS)).cast("int")
    dealt = packs.withColumn("group", group).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(len(slices) - 1))))
    dealt = dealt.where(F.element_at(F.array(*[F.lit(f) for f, _, _ in slices]), F.col("slice") + 1) != F.col("fold"))
    dealt = dealt.select("slice", "group", "block", "fold", "y", "codes").repartition(min(4 * wide, GROUPS * len(slices)), "slice", "group").sortWithinPartitions("slice", "group").persist(StorageLevel.MEMORY_AND_DISK)
    split: dict[int, dict[int, tuple[int, int]]] = {}
    done: dict[int, list[tuple[np.ndarray, ...]]] = {}
    large = {order[f] * trees + i: [1] for f, n in rows.items() if n > SMALL for i in range(trees)}

    def bags(batch: pa.RecordBatch):
        """Of each block and tree: (slice, group, tree, codes, y, n, nodes) of the rows that count there."""
        for s, g, block, fold, y, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            f, first, end = slices[s]
            y = np.frombuffer(y, np.int32).astype(np.int64)
            codes = np.frombuffer(codes, np.uint8).reshape(len(y), -1)
            for i in range(first, end):
                tree = order[f] * trees + i
                n = np.random.default_rng([seed, 0, tree, fold, block]).poisson(1.0, len(y))
                on = np.flatnonzero(n)
                c, at, known = codes[on], np.ones(len(on), np.int64), split.get(tree, {})
                for node, (feature, bin_) in known.items():  # parents come first
                    there = at == node
                    at[there] = 2 * node + (c[there, feature] > bin_)
                yield s, g, tree, c, y[on], n[on], at

    try:
        while any(large.values()):
            now = {t: np.array(k) for t, k in large.items() if k}
            picks = {t: np.stack([tried(seed, t, k, features) for k in nodes.tolist()]) for t, nodes in now.items()}

            def count(batches: Iterator[pa.RecordBatch], now: dict = now, picks: dict = picks) -> Iterator[pa.RecordBatch]:
                held, last = {}, None

                def told() -> pa.RecordBatch:
                    return pa.RecordBatch.from_pydict({"tree": pa.array(list(held), pa.int32()), "w": pa.array([h.tobytes() for h in held.values()], pa.binary())})

                for b in batches:
                    for s, g, tree, c, y, n, at in bags(b):
                        if (s, g) != last:
                            if held:
                                yield told()
                            held, last = {}, (s, g)
                        if tree in now:
                            place = np.searchsorted(now[tree], at)
                            keep = now[tree][np.minimum(place, len(now[tree]) - 1)] == at
                            held[tree] = held.get(tree, 0.0) + counts_by_bin(c[keep], y[keep], n[keep], place[keep], picks[tree], classes)
                if held:
                    yield told()

            def best(t: pa.Table) -> pa.Table:  # ends before the next level
                tree = t["tree"][0].as_py()
                hist = np.sum([np.frombuffer(w.as_py(), float) for w in t["w"]], axis=0).reshape(*picks[tree].shape, BINS, classes)  # noqa: B023
                slot, bin_, left, fine = best_splits(hist, weights[sorted(weights)[tree // trees]])
                found = np.where(fine, picks[tree][np.arange(len(slot)), slot], -1)
                return pa.table({"tree": t["tree"].slice(0, 1), "feature": [found.astype(np.int64)], "bin": [bin_], "left": [left.ravel()], "whole": [hist[:, 0].sum(1).ravel()]})

            for r in dealt.mapInArrow(count, "tree int, w binary").groupBy("tree").applyInArrow(best, "tree int, feature array<long>, bin array<long>, left array<double>, whole array<double>").collect():
                tree, nodes = r["tree"], now[r["tree"]]
                left, whole = np.array(r["left"]).reshape(-1, classes), np.array(r["whole"]).reshape(-1, classes)
                share = whole * weights[sorted(weights)[tree // trees]]
                done.setdefault(tree, []).append((nodes, np.array(r["feature"]), np.array(r["bin"]), share / share.sum(1, keepdims=True)))
                large[tree] = []
                for k, node in enumerate(nodes.tolist()):
                    if r["feature"][k] < 0:
                        continue
                    split.setdefault(tree, {})[node] = (r["feature"][k], r["bin"][k])
                    for child, size in ((2 * node, left[k]), (2 * node + 1, whole[k] - left[k])):
                        if child.bit_length() > depth or np.count_nonzero(size) < 2:  # a leaf of any size
                            s = size * weights[sorted(weights)[tree // trees]]
                            done[tree].append((np.array([child]), np.array([-1]), np.array([0]), (s / s.sum())[None]))
                        elif size.sum() > SMALL:
                            large[tree].append(child)
        ended = {t: {int(k) for nodes, *_ in parts for k in nodes} for t, parts in done.items()}

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, tree, c, y, n, at in bags(b):
                    by = np.argsort(at, kind="stable")
                    at = at[by]
                    ends = np.flatnonzero(np.r_[at[1:] != at[:-1], True][: len(at)]) + 1
                    told = [(int(at[a]), by[a:e]) for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if int(at[a]) not in ended.get(tree, ())]
                    if told:
                        bytes_ = [pa.array([x[k].astype(kind).tobytes() for _, k in told], pa.binary()) for x, kind in ((c, np.uint8), (y, np.int32), (n, np.int32))]
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * len(told), pa.int32()), pa.array([k for k, _ in told], pa.int64()), *bytes_], ["tree", "node", "codes", "y", "n"])

        def grow(t: pa.Table) -> pa.Table:
            tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
            rows = sorted(zip(*(t[c].to_pylist() for c in ("codes", "y", "n")), strict=True))  # one order of rows
            codes, y, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows, strict=True), (np.uint8, np.int32, np.int32), strict=True))
            parts = below(codes.reshape(len(y), -1), y.astype(np.int64), n.astype(float), weights[sorted(weights)[tree // trees]], seed, tree, node, depth)
            flat = [np.concatenate(x).astype(kind).tobytes() for x, kind in zip(zip(*parts, strict=True), (np.int64, np.int16, np.uint8, np.float32), strict=True)]
            return pa.table({"tree": t["tree"].slice(0, 1), **{c: pa.array([x], pa.binary()) for c, x in zip(("node", "feature", "bin", "share"), flat, strict=True)}})

        found = dealt.mapInArrow(sent, "tree int, node long, codes binary, y binary, n binary").groupBy("tree", "node").applyInArrow(grow, "tree int, node binary, feature binary, bin binary, share binary").checkpoint()  # all partitions at once
        for r in found.toLocalIterator():
            done.setdefault(r["tree"], []).append((np.frombuffer(r["node"], np.int64), np.frombuffer(r["feature"], np.int16), np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["share"], np.float32).reshape(-1, classes)))
    finally:
        dealt.unpersist()
    return {f: [Tree(done[order[f] * trees + i]) for i in range(trees) if order[f] * trees + i in done] for f in weights}


def permuted_hits(trees: list[Tree], y: np.ndarray, codes: np.ndarray, classes: int, repeats: int, random: np.random.Generator) -> np.ndarray:
    """How many rows of each class a forest finds: a line for the rows as they are, then one for each repeat and feature with that
    feature permuted among the rows. Only where a row's way through a tree asks for the feature is it gone anew."""
    m, features = codes.shape
    new = np.stack([random.permuted(codes, axis=0) for _ in range(repeats)])
    base, moved = np.zeros((m, classes), np.float32), np.zeros((repeats, features, m, classes), np.float32)
    for tree in trees:
        asked = np.zeros((m, features), bool)
        for live, f, at in tree.reached(lambda k, f: codes[k, f], m):
            asked[live, f] = True
        own = tree.share[at]
        base += own
        row, feature = np.nonzero(asked)
        r, row, feature = np.repeat(np.arange(repeats), len(row)), np.tile(row, repeats), np.tile(feature, repeats)
        other = new[r, row, feature]
        change = other != codes[row, feature]
        r, row, feature, other = r[change], row[change], feature[change], other[change]
        for _, _, at in tree.reached(lambda k, f: np.where(f == feature[k], other[k], codes[row[k], f]), len(row)):  # noqa: B023
            pass
        moved[r, feature, row] += tree.share[at] - own[row]
    hit = np.concatenate([base[None], (base + moved).reshape(-1, m, classes)]).argmax(2) == y
    return hit @ np.eye(classes)[y]


def importance(rows: DataFrame, key: str, group: str, vector: str, names: list[str], replicate: str | None = None, scheme: str = "auto", k: int = 5, trees: int = TREES, depth: int = DEPTH, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """(feature, importance, sd, rank, balanced_accuracy): how much balanced accuracy on held-out rows is lost when a
    feature's values are permuted among them; mean and deviation over folds of the mean over repeats.

    All folds' forests grow together (`forests`), their groups weighing alike. A fold's held-out rows lie in random blocks (of
    some 500 rows: all of them in one where they are fewer), and values are permuted within a block, so no row is moved for it.
    Ties rank by name. Without two groups of two rows there is no row.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"), *([F.col(replicate).alias("rep")] if replicate else []))
    spark = rows.sparkSession
    schema = "feature string, importance double, sd double, rank int, balanced_accuracy double"
    counts = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return spark.createDataFrame([], schema)
    groups = sorted(counts)
    configured(spark)
    plan, _ = fold_plan(rows, "key", "g", "rep" if replicate else None, "stratified" if scheme == "auto" and not replicate else scheme, k, 1, seed)
    dealt = rows.join(plan.select(F.col("key").alias("k"), F.col("folds")[0].alias("fold")), F.col("key") == F.col("k")).select("key", "g", "v", "fold").checkpoint()
    sample = np.array([r["v"] for r in dealt.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(SAMPLE).select("v").collect()], float)
    cuts = np.quantile(sample, np.arange(1, BINS) / BINS, axis=0).T
    held = {(r["fold"], r["g"]): r["count"] for r in dealt.groupBy("fold", "g").count().collect()}
    folds = sorted({f for f, _ in held})
    sizes = {f: sum(n for (e, _), n in held.items() if e == f) for f in folds}
    packs = binned(dealt, cuts, groups, sizes)
    rest = {f: np.array([counts[g] - held.get((f, g), 0) for g in groups], float) for f in folds}
    weights = {f: np.where(n > 0, n.sum() / (len(groups) * np.maximum(n, 1)), 0.0) for f, n in rest.items()}
    grown = forests(packs, weights, {f: int(n.sum()) for f, n in rest.items()}, len(names), trees, depth, seed)
    lost, base = [], []
    for f in folds:
        sent = spark.sparkContext.broadcast(grown.pop(f))  # at most 2 ** (depth + 1) nodes a tree, whatever the rows

        def score(batches: Iterator[pa.RecordBatch], f: int = f, sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                for block, y, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    y = np.frombuffer(y, np.int32)
                    total = total + permuted_hits(sent.value, y, np.frombuffer(codes, np.uint8).reshape(len(y), -1), len(groups), repeats, np.random.default_rng([seed, 2, f, block]))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

        own = packs.where(F.col("fold") == f).select("block", "y", "codes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
        hits = np.frombuffer(summed(own.mapInArrow(score, "k int, w binary"), "k").first()["w"], float).reshape(-1, len(groups))
        n = np.array([held.get((f, g), 0) for g in groups], float)
        recall = (hits[:, n > 0] / n[n > 0]).mean(1)
        base.append(recall[0])
        lost.append(recall[0] - recall[1:].reshape(repeats, -1).mean(0))
        sent.destroy()
    mean, sd = np.mean(lost, 0), np.std(lost, 0)
    order = sorted(range(len(names)), key=lambda j: (-mean[j], names[j]))
    return spark.createDataFrame([(names[j], float(mean[j]), float(sd[j]), i + 1, float(np.mean(base))) for i, j in enumerate(order)], schema)
