"""A graph of each row's nearest rows, by descent: who is near a near row is likely near as well.

A first graph comes from buckets of a few random hyperplanes, within which all rows are compared. In a round every row brings
the rows it names, and a drawn part of those that name it, together; what is nearer than the farthest one known takes its
place. Rounds end when few places change. No step holds more than a block of rows, and the work of a round grows with the
rows times the square of the neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordination import configured

#: Rows of a bucket of the first graph, and its tables; rows whose candidates meet in one call.
BUCKET, TABLES, BLOCK = 256, 3, 500


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; 0 where they are within what rounding makes of equal rows."""
    sums = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    d = sums - 2 * (a @ b.T)
    d[d < 1e-13 * sums] = 0
    return d


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy().astype(float).reshape(len(x), -1)


def numbers(rows: DataFrame, vector: str) -> Column:
    """The vector as it travels: floats stay floats, half as large, and become doubles where distances are computed."""
    return F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node's (node, other, d, fresh), each other row once; ties go to the lesser row. A filter on row
    numbers limits each task's rows of a node before they are moved, so a node with very many costs little."""
    once = found.groupBy("node", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _bits(vector: Column, planes: np.ndarray, means: np.ndarray) -> Column:
    """On which side of each plane through the means a row lies."""
    out = F.lit(0)
    for b, p in enumerate(planes):
        side = F.aggregate(F.zip_with(vector.cast("array<double>"), F.array(*map(F.lit, p.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) > float(p @ means)
        out = out + F.when(side, F.lit(1 << b)).otherwise(F.lit(0))
    return out


def neighbour_graph(rows: DataFrame, key: str, vector: str, k: int = 15, rounds: int = 12, stop: float = 0.002, seed: int = 7) -> DataFrame:
    """(node, other, d): for each row the k nearest rows found and their Euclidean distances; fewer where there are fewer rows.

    rows: key unique, vector an array of one length. Rows whose key or vector is null are left out; equal vectors are
    neighbours at 0. An empty table, or one row, gives none. The graph is approximate where a table has more than a bucket of
    rows (tests and README state what share of the true neighbours it holds). rounds end early when less than stop of
    all places change.
    """
    spark = rows.sparkSession
    configured(spark)
    base = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("node"), numbers(rows, vector).alias("x")).checkpoint()
    n = base.count()
    k = min(k, n - 1)
    if k < 1:
        return spark.createDataFrame([], "node long, other long, d double")
    d = base.select(F.size("x")).first()[0]
    # an aggregate a component is a wide plan; the means come as (place, value) rows
    means = np.zeros(d)
    for r in base.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).collect():
        means[r["p"]] = r["m"]
    random = np.random.default_rng(seed)
    bits = min(24, max(0, int(np.ceil(np.log2(n / BUCKET))))) if n > BUCKET else 0

    def within(t: pa.Table) -> pa.Table:
        node, x = t["node"].to_numpy(), matrix(t["x"])
        own, most = [], min(k, len(node) - 1)
        if most < 1:
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "fresh": pa.array([], pa.int32())})
        for a in range(0, len(node), BLOCK):
            q = squared(x[a : a + BLOCK], x)
            q[np.arange(len(q)), np.arange(a, a + len(q))] = np.inf
            at = np.argpartition(q, most - 1, axis=1)[:, :most]
            own.append((np.repeat(node[a : a + BLOCK], most), node[at].reshape(-1), np.sqrt(np.take_along_axis(q, at, 1)).reshape(-1)))
        i, j, dist = (np.concatenate(c) for c in zip(*own, strict=True))
        return pa.table({"node": i, "other": j, "d": dist, "fresh": np.ones(len(i), np.int32)})

    tables = [base.withColumn("bucket", _bits(F.col("x"), random.normal(size=(bits, d)), means)).withColumn("table", F.lit(t)) for t in range(TABLES if bits else 1)]
    placed = tables[0]
    for t in tables[1:]:
        placed = placed.unionByName(t)
    # a bucket of many rows is dealt to several, so that none is more than a task bears
    sizes = placed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / (2 * BUCKET)).alias("parts"))
    placed = placed.join(sizes, ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "table"), F.col("parts")))
    shape = "node long, other long, d double, fresh int"
    graph = nearest(placed.groupBy("table", "bucket", "part").applyInArrow(within, shape), k).checkpoint()
    if n <= 2 * BUCKET and not bits:
        return graph.select("node", "other", "d")
    blocks = max(1, -(-n // BLOCK))

    def meet(t: pa.Table) -> pa.Table:
        """Of the candidates that a node brings together, the pairs that are nearer than what one of both knows."""
        t = t.sort_by("node")
        node, cand, fresh, worst, x = t["node"].to_numpy(), t["cand"].to_numpy(), t["fresh"].to_numpy() > 0, t["worst"].to_numpy(), matrix(t["x"])
        edges = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)]
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q = np.sqrt(squared(x[a:b], x[a:b]))
            c, w = cand[a:b], worst[a:b]
            near = (q < w[:, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (c[:, None] != c)
            i, j = np.nonzero(near)
            out.append((c[i], c[j], q[i, j]))
        i, j, dist = (np.concatenate(col) for col in zip(*out, strict=True))
        return pa.table({"node": i, "other": j, "d": dist, "fresh": np.ones(len(i), np.int32)})

    for step in range(rounds):
        named = graph.select("node", F.col("other").alias("cand"), "fresh")
        back = graph.select(F.col("other").alias("node"), F.col("node").alias("cand"), "fresh")
        draw = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("cand", F.lit(seed + step)), "cand"))
        back = back.withColumn("place", draw).where(F.col("place") <= k).drop("place")
        both = named.unionByName(back).groupBy("node", "cand").agg(F.max("fresh").alias("fresh"))
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = base.join(worst, "node", "left").select(F.col("node").alias("cand"), "x", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        brought = both.join(known, "cand").withColumn("block", F.pmod(F.xxhash64("node", F.lit(step)), F.lit(blocks)))
        better = brought.groupBy("block").applyInArrow(meet, shape)
        graph = nearest(graph.withColumn("fresh", F.lit(0)).unionByName(better), k).checkpoint()
        if graph.where("fresh > 0").count() < stop * n * k:
            break
    return graph.select("node", "other", "d")


def exact_neighbours(rows: DataFrame, key: str, vector: str, k: int, queries: Column) -> DataFrame:
    """(node, other, d): the k nearest rows of every row for which queries holds, compared with all rows block by block;
    what a block finds is k rows a query. The queries are a stated part of the rows, which goes to all tasks in blocks."""
    configured(rows.sparkSession)
    base = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).withColumn("is_query", queries)
    base = base.select(F.col(key).cast("long").alias("node"), numbers(rows, vector).alias("x"), "is_query").checkpoint()
    n, asked = base.count(), base.where("is_query").count()
    blocks, many = max(1, -(-n // (4 * BLOCK))), max(1, -(-asked // (4 * BLOCK)))
    q = base.where("is_query").select("node", "x", F.pmod(F.xxhash64("node"), F.lit(many)).alias("q"), F.lit(True).alias("asks")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = base.select("node", "x", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("asks")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))

    def search(t: pa.Table) -> pa.Table:
        asks, node, x = t["asks"].to_numpy().astype(bool), t["node"].to_numpy(), matrix(t["x"])
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        dist = np.sqrt(squared(x[a], x[b]))
        dist[node[a][:, None] == node[b]] = np.inf
        at = np.argsort(dist, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(dist, at, 1)
        i, c = np.nonzero(np.isfinite(found))
        return pa.table({"node": node[a][i], "other": node[b][at[i, c]], "d": found[i, c], "fresh": np.zeros(len(i), np.int32)})

    met = q.select("node", "x", "q", "b", "asks").unionByName(r.select("node", "x", "q", "b", "asks"))
    return nearest(met.groupBy("q", "b").applyInArrow(search, "node long, other long, d double, fresh int"), k).drop("fresh")


def recall(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, neighbours, recall): what share of the exact neighbours the graph holds; one as near as the farthest exact
    neighbour counts, whichever of equals it is."""
    reach = exact.groupBy("node").agg(F.max("d").alias("reach"), F.count("*").alias("all"))
    held = graph.join(reach, "node").where(F.col("d") <= F.col("reach") * (1 + 1e-9) + 1e-7).groupBy("node").agg(F.count("*").alias("held"))
    each = reach.join(held, "node", "left").select("all", F.least("all", F.coalesce("held", F.lit(0))).alias("held"))
    return each.agg(F.count("*").alias("queries"), F.sum("all").alias("neighbours"), (F.sum("held") / F.sum("all")).alias("recall"))


def spread(batches: Iterator[pa.RecordBatch], k: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch of (node, others, ds ascending) with the weights of its neighbours, as rows of one width padded with 0.

    A weight is exp(-(d - nearest) / s), where nearest is the least distance above 0 and s makes the sum log2(k).
    """
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        d = np.full((batch.num_rows, int(sizes.max(initial=0))), np.inf)
        on = np.arange(d.shape[1]) < sizes[:, None]
        d[on] = lists.flatten().to_numpy()
        above = np.where(on & (d > 0), d, np.inf).min(1, initial=np.inf)
        gap = np.maximum(np.where(on, d, 0) - np.where(np.isfinite(above), above, 0)[:, None], 0)
        low, high = np.full(len(d), 0.0), np.full(len(d), np.inf)
        s, want = np.ones(len(d)), np.log2(max(k, 2))
        for _ in range(64):
            total = np.where(on, np.exp(-gap / s[:, None]), 0).sum(1)
            wide = total > want
            high, low = np.where(wide, s, high), np.where(wide, low, s)
            s = np.where(np.isinf(high), s * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
        mean = np.where(on, d, 0).sum(1) / np.maximum(sizes, 1)
        s = np.maximum(s, 1e-3 * np.where(mean > 0, mean, 1.0))
        yield batch, np.where(on, np.exp(-gap / s[:, None]), 0)


def fuzzy_union(graph: DataFrame, k: int) -> DataFrame:
    """(a, b, w), a < b: the neighbours' weights of both ends joined, w + v - w v; an edge that one end names keeps its w."""
    lists = graph.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("l"))
    lists = lists.select("node", F.col("l.other").alias("others"), F.col("l.d").alias("ds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in spread(batches, k):
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            i, j = np.repeat(batch.column(0).to_numpy(), sizes), batch.column(1).flatten().to_numpy()
            yield pa.RecordBatch.from_pydict({"a": np.minimum(i, j), "b": np.maximum(i, j), "w": w[np.arange(w.shape[1]) < sizes[:, None]]})

    edges = lists.mapInArrow(run, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("s"), F.min("w").alias("v"), F.count("*").alias("c"))
    return edges.select("a", "b", (F.col("s") - F.when(F.col("c") > 1, F.col("v") * (F.col("s") - F.col("v"))).otherwise(0.0)).alias("w")).where("w > 0")
