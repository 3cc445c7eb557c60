"""Near-duplicate embeddings by a forest of random-projection trees.

A node of a tree splits along a random direction at a random place of an interval as wide as the node's quartiles lie apart,
and spills: what lies within half a band of that place goes to both sides. A pair is parted only if the place falls between
its two by more than the band leaves, which has a chance of E(gap - band) / width at most, wherever the pair lies. The band is
as wide as keeps a pair at COSINE together in a tree with the probability that leaves all trees to part it with LOSS at most,
at any size. A node that the band keeps from getting smaller is a leaf.
The trees are fitted on a sample of at most SAMPLE vectors; every vector is routed through all of them. Vectors that share
a leaf and a label are compared exactly, those of a large leaf in blocks dealt to several tasks. Equal vectors are one
class and compared once. Of a leaf only counts and a spanning forest of its links are passed on, never its pairs; a pair
is counted in the first leaf that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configured, of_classes, parallelism, schema, stored, trimming
from .components import Forest, components

COSINE, TREES, LEAF, SAMPLE = 0.98, 8, 64, 20_000
#: A leaf holds at most LEAF vectors of a label, and in smaller tables the largest label's vectors by so many.
SPLITS = 16
#: How likely a pair at the threshold may share no leaf of any tree.
LOSS = 1e-9
#: A split has to bring a node's pairs down to this share; so many directions are tried.
WORTH, TRIES = 0.8, 4
#: What share of a node its larger child has as a rule, which tells how deep trees get; sampled vectors that a split needs.
LARGER, FEWEST = 0.62, 16
#: A leaf of more vectors is compared by blocks, a pair of them in a task.
MOST = 3000
#: Vectors compared at once.
TILE = 1000


@dataclass
class Tree:
    """Inner nodes, the root first; a child below zero is the leaf ~child."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, labels: np.ndarray, each: float, leaf: int, depth: int, part: float, rng: np.random.Generator) -> Tree:
        """labels: small numbers; each: how many vectors one of x stands for; leaf: vectors of a label that need no split;
        part: how likely a split may part a pair at the threshold."""
        directions, low, high, children, leaves = [], [], [], [], 0
        bands = Bands(x.shape[1])
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            at, level, parent, side = todo.pop()
            here = ~leaves
            if level < depth and len(at) >= FEWEST and each * np.bincount(labels[at]).max() > leaf:
                near = x[at]
                width = np.subtract(*np.quantile(near @ unit(rng.normal(size=(TRIES, x.shape[1]))).T, [0.75, 0.25], axis=0)).mean()
                band = bands.of(part * width)
                for d in unit(rng.normal(size=(TRIES, x.shape[1]))):
                    p = near @ d
                    place = np.median(p) + width * (rng.random() - 0.5)
                    left, right = at[p <= place + band / 2], at[p >= place - band / 2]
                    if len(left) ** 2 + len(right) ** 2 <= WORTH * len(at) ** 2:
                        here = len(low)
                        directions.append(d)
                        low.append(place - band / 2)
                        high.append(place + band / 2)
                        children.append([0, 0])
                        todo += [(left, level + 1, here, 0), (right, level + 1, here, 1)]
                        break
            leaves += here < 0
            if parent >= 0:
                children[parent][side] = here
        return cls(np.array(directions).reshape(-1, x.shape[1]), np.array(low), np.array(high), np.array(children, np.int64).reshape(-1, 2))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf), a row in one leaf or in several."""
        row, node = np.arange(len(x)), np.full(len(x), 0 if len(self.low) else -1, np.int64)
        rows, found = [], []
        while len(row):
            inner = node >= 0
            rows.append(row[~inner])
            found.append(~node[~inner])
            row, node = row[inner], node[inner]
            p = np.einsum("ij,ij->i", x[row], self.directions[node])
            left, right = p <= self.high[node], p >= self.low[node]
            row, node = np.r_[row[left], row[right]], np.r_[self.children[node[left], 0], self.children[node[right], 1]]
        return np.concatenate(rows), np.concatenate(found)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Bands:
    """By how much the gap of a pair at the threshold exceeds a band, on average over random directions in d dimensions.

    The cosine t of a random direction and the pair's difference has a density in proportion to (1 - t^2)^((d - 3) / 2).
    """

    def __init__(self, d: int, parts: int = 4096) -> None:
        self.far = (2 - 2 * COSINE) ** 0.5 + 1e-9
        t = (np.arange(parts) + 0.5) / parts
        w = (1 - t * t) ** ((d - 3) / 2)
        w, self.t = w / w.sum(), np.arange(parts + 1) / parts
        beyond, moment = (np.r_[np.cumsum(v[::-1])[::-1], 0] for v in (w, w * t))
        self.excess = self.far * (moment - self.t * beyond)
        self.flat = d < 3

    def of(self, excess: float) -> float:
        """The least band that the gap exceeds by so much at most; below three dimensions the pair's whole distance."""
        return self.far * float(1 if self.flat else self.t[min(int(np.searchsorted(-self.excess, -excess)), len(self.t) - 1)])


def part_of(depth: int, trees: int) -> float:
    """How likely a split may part a pair, so that all of so many trees of such a depth part it with LOSS at most."""
    return 1 - (1 - LOSS ** (1 / trees)) ** (1 / max(1, depth))


def depth_of(n: int, leaf: int, sample: int) -> int:
    """Splits on the way to leaves of so many of n vectors, as far as the sample goes; none where n is a leaf."""
    ratio = min(n / leaf, max(1.0, sample / FEWEST)) if n > leaf else 1
    return int(np.ceil(np.log(ratio) / -np.log(LARGER)))


def shared(a: np.ndarray, b: np.ndarray, leaf: int, linked: np.ndarray) -> np.ndarray:
    """Which linked pairs share a leaf before this one. a, b: the rows' leaves, padded with -1."""
    out = np.zeros(linked.shape, bool)
    a, b = np.where(a < leaf, a, -1), np.where(b < leaf, b, -1)
    if (a < 0).all() or (b < 0).all():
        return out
    if np.count_nonzero(linked) <= 10_000:
        r, c = np.nonzero(linked)
        out[r, c] = ((a[r][:, :, None] == b[c][:, None, :]) & (a[r] >= 0)[:, :, None]).any((1, 2))
        return out
    (a, of_a), (b, of_b) = np.unique(a, axis=0, return_inverse=True), np.unique(b, axis=0, return_inverse=True)
    leaves = np.intersect1d(a, b)
    leaves = leaves[leaves >= 0]
    if not len(leaves):
        return out
    held = []
    for x in (a, b):
        at = np.minimum(np.searchsorted(leaves, x), len(leaves) - 1)
        r, c = np.nonzero(leaves[at] == x)
        m = np.zeros((len(x), len(leaves)), np.float32)
        m[r, at[r, c]] = 1
        held.append(m)
    return (held[0] @ held[1].T > 0)[of_a.reshape(-1)][:, of_b.reshape(-1)]


def compared(ids: np.ndarray, n: np.ndarray, x: np.ndarray, seen: np.ndarray, leaf: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, links) of the pairs of left and right, which are the same positions or have none in common: links that span
    what is linked, and for each linked class (b: -1) how many vectors it links with by pairs that share no earlier leaf.
    seen: each row's leaves, padded with -1."""
    norm, same = np.sqrt(np.einsum("ij,ij->i", x, x)), left is right
    forest, root, total = Forest(len(x)), np.arange(len(x)), np.zeros(len(x))
    tied = [np.zeros((0, 2), np.int64)]
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            p, q = left[i : i + TILE], right[j : j + TILE]
            linked = (x[p] @ x[q].T) / (norm[p][:, None] * norm[q]) >= COSINE
            once = same and i == j
            if once:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            while (apart := linked & (root[p][:, None] != root[q])).any():
                at = np.flatnonzero(apart.any(1))
                tied.append(forest.join(np.stack([p[at], q[apart[at].argmax(1)]], 1)))
                root = forest.parent
                while (root[root] != root).any():
                    root = root[root]
            fresh = (linked & ~shared(seen[p], seen[q], leaf, linked)).astype(np.float64)
            total[p] += fresh @ n[q]
            if not once:
                total[q] += n[p] @ fresh
    pairs, at = np.concatenate(tied), np.flatnonzero(total)
    return np.r_[ids[pairs[:, 0]], ids[at]], np.r_[ids[pairs[:, 1]], np.full(len(at), -1)], np.r_[np.zeros(len(pairs), np.int64), total[at].astype(np.int64)]


def links_of(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: np.concatenate([p[k] for p in parts]).astype(np.int64) for k, name in enumerate("abw")})


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows in a row that agree in the columns by, whatever batches they come in."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        change = np.zeros(max(0, t.num_rows - 1), bool)
        for c in by:
            x = t[c].combine_chunks()
            change |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def usable(embedding: Column, label: Column) -> Column:
    """Not null, with a label, finite in every component, and not zero."""
    x = embedding.cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & whole & F.exists(x, lambda v: v != 0), F.lit(False))


def near_vectors(table: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label) of table.

    Rows link at a cosine of COSINE or more if their labels are equal and not null; rows that repeat link with each other.
    Null, zero or non-finite vectors link with nothing and are kept; so do vectors of different lengths with each other.
    A null vec_id is never a component_id; kept is false there unless the row is alone. An empty table gives no rows; other
    columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("ok", usable(F.col("embedding"), F.col("label")))
    classes = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "label", "embedding", "least", "n"), "classes")
    sizes = classes.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    leaf = max(1, min(LEAF, (sizes["n"] or 0) // SPLITS))
    depth = depth_of(sizes["n"] or 0, leaf, sample)
    forests = fitted(classes, sizes["all"] or 0, sample, trees, leaf, depth, seed)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, sizes = batch.column(2), pc.list_value_length(batch.column(2)).to_numpy()
            values, begins = vectors.flatten().to_numpy().astype(np.float64), np.cumsum(sizes) - sizes
            rows, leaves = [], []
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                u = unit(values[begins[at][:, None] + np.arange(d)])
                found = [tree.leaves(u) for tree in forests.get(d, [])] or [(np.arange(len(at)), np.zeros(len(at), np.int64))]
                rows += [at[r] for r, _ in found]
                leaves += [(k << 32) + x for k, (_, x) in enumerate(found)]
            if not rows:
                continue
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            by = np.lexsort((leaf, row))
            row, leaf = row[by], pa.array(leaf[by])
            own = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), leaf)
            take = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*take.columns, leaf, own.take(pa.array(row))], [*take.schema.names, "leaf", "leaves"])

    kind = classes.schema["embedding"].dataType.simpleString()
    of_label = classes.schema["label"].dataType
    plain = F.col("label") if isinstance(of_label, (T.IntegralType, T.StringType, T.BooleanType, T.DecimalType, T.DateType)) else F.col("label").cast("string")
    given = classes.select("class", plain.alias("label"), "embedding", "n")
    routed = given.mapInArrow(trimming(route), schema(f"class long, label {given.schema['label'].dataType.simpleString()}, embedding {kind}, n long, leaf long, leaves array<long>"))

    place = ["label", "leaf", "d"]
    routed = routed.withColumn("d", F.size("embedding"))
    if (sizes["n"] or 0) > MOST:
        large = stored(routed.groupBy(*place).agg(F.count("*").alias("size")).where(F.col("size") > MOST).select(*place, F.ceil(F.col("size") / MOST).cast("int").alias("blocks")), "large")
        routed = routed.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        routed = routed.withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        routed = routed.withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    routed = routed.select("class", "n", "embedding", "leaves", *place, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    by = [*place, "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for t in runs(batches, by):
            own, i, j = t["own"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
            left = np.flatnonzero(own == i)
            right = left if i == j else np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            lists = t["leaves"].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            seen = np.full((len(sizes), sizes.max()), -1, np.int64)
            seen[np.arange(seen.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
            vectors = t["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
            out.append(compared(t["class"].to_numpy(), t["n"].to_numpy(), vectors, seen, int(t["leaf"][0].as_py()), left, right))
            if sum(len(a) for a, _, _ in out) > TILE or len(out) > TILE:
                yield links_of(out)
                out = []
        if out:
            yield links_of(out)

    dealt = routed.repartition(parallelism(spark), *by).sortWithinPartitions(*by)
    found = stored(dealt.mapInArrow(trimming(meet), schema("a long, b long, w long")), "links")
    counts = found.where("b < 0").groupBy(F.col("a").alias("counted")).agg(F.sum("w").alias("w"))
    roots = components(found.where("b >= 0").select("a", "b"))
    named = roots.join(classes, F.col("node") == F.col("class")).groupBy("root").agg(F.min("least").alias("first")).join(roots, "root").select("node", "first")
    of = classes.join(counts, F.col("class") == F.col("counted"), "left").join(named, F.col("class") == F.col("node"), "left")
    of = of.select(F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"), (F.coalesce("w", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("first", "least").alias("component_id"), "n")
    linked = of_classes(rows.where("ok"), stored(of, "named"), {"label": "of_label", "embedding": "of_embedding"}).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0))


def fitted(classes: DataFrame, size: int, sample: int, trees: int, leaf: int, depth: int, seed: int) -> dict[int, list[Tree]]:
    """The trees for each length of vector, from at most `sample` of the `size` classes, drawn by hash."""
    if not depth:
        return {}
    share = min(1.0, 1.2 * sample / size)
    drawn = classes.where(F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select("embedding", F.xxhash64("label").alias("label")).limit(sample).collect()
    out = {}
    for d in {len(r[0]) for r in drawn}:
        x = unit(np.array([r[0] for r in drawn if len(r[0]) == d], np.float64))
        labels = np.unique([r[1] for r in drawn if len(r[0]) == d], return_inverse=True)[1]
        out[d] = [Tree.fitted(x, labels, size / len(drawn), leaf, depth, part_of(depth, trees), np.random.default_rng([seed, k])) for k in range(trees)]
    return out


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(configured(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
