"""Tests of differences between groups, and their permutations, as aggregations.

Permutations order rows by md5 of a seed and the row's id, so that any engine draws the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


# --- design ----------------------------------------------------------------------------------------------------------


def design(table: DataFrame, group: str, replicate: str) -> DataFrame:
    """One row: replicates, how many of them hold one group, and the design that follows: none (under two replicates),
    nested (each holds one group), crossed (none does) or mixed."""
    per = table.groupBy(F.col(replicate).alias("r")).agg(F.countDistinct(group).alias("g"))
    a = per.agg(F.count("*").alias("replicates"), F.count(F.when(F.col("g") == 1, 1)).alias("pure"))
    kind = F.when(F.col("replicates") < 2, "none").when(F.col("pure") == F.col("replicates"), "nested").when(F.col("pure") == 0, "crossed").otherwise("mixed")
    return a.withColumn("design", kind)


def unit_means(table: DataFrame, features: list[str], group: str, replicate: str) -> DataFrame:
    """Mean of each feature by replicate, with the replicate's most frequent group (the smallest of equals)."""
    counts = table.groupBy(replicate, group).agg(F.count("*").alias("c"))
    modal = counts.groupBy(F.col(replicate).alias("r")).agg(F.min_by(F.col(group), F.struct(-F.col("c"), F.col(group))).alias(group))
    means = table.groupBy(replicate).agg(*[F.avg(c).alias(c) for c in features])
    return means.join(modal, F.col(replicate) == F.col("r")).drop("r")


def drawn(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def permuted(table: DataFrame, key: str, group: str, seed: int, within: str | None = None, unit: str | None = None) -> DataFrame:
    """(key, permuted): groups dealt anew, over all rows, within blocks, or (unit) over whole replicates."""
    if unit is not None:
        units = table.groupBy(unit).agg(F.min(group).alias("g"))
        dealt = permuted(units, unit, "g", seed).withColumnRenamed(unit, "u")
        return table.join(dealt, F.col(unit) == F.col("u")).select(key, "permuted")
    part = [F.col(within)] if within else []
    a = table.select(F.col(key), *part, F.row_number().over(Window.partitionBy(*part).orderBy(drawn(seed, F.col(key)))).alias("n"))
    b = table.select(*[p.alias("_w") for p in part], F.col(group).alias("permuted"), F.row_number().over(Window.partitionBy(*part).orderBy(key)).alias("m"))
    on = F.col("n") == F.col("m")
    return a.join(b, on & (F.col(within) == F.col("_w")) if within else on).select(key, "permuted")


def effective_permutations(sizes: list[int], most: float = 1e9) -> float:
    """Distinct ways to deal labels of these counts."""
    out, n = 1.0, 0
    for s in sizes:
        for k in range(1, s + 1):
            n += 1
            out = out * n / k
            if out > most:
                return most
    return out


def permutation_p(hits: int, draws: int) -> float:
    """Never zero."""
    return (1 + hits) / (1 + draws)


# --- multivariate ----------------------------------------------------------------------------------------------------


def coordinates(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(k, g, d, v): a row a coordinate."""
    return vectors.select(F.col(key).alias("k"), F.col(group).alias("g"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "v"))


def permanova(long: DataFrame) -> DataFrame:
    """n, groups, pseudo_F and R2 of Euclidean distances: sums of squares around centroids, which equal the pairwise
    definition. Partial sums only; no pair is formed."""
    cell = long.groupBy("g", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    within = cell.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"))
    total = cell.groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("t"), F.max("n").alias("n"))
    groups = cell.agg(F.countDistinct("g").alias("groups"))
    x = within.crossJoin(total).crossJoin(groups)
    between = F.col("t") - F.col("w")
    return x.select("n", "groups", ratio(between / (F.col("groups") - 1), F.col("w") / (F.col("n") - F.col("groups"))).alias("pseudo_F"), ratio(between, F.col("t")).alias("R2"))


def permanova_null(vectors: DataFrame, key: str, group: str, vector: str, seeds: list[int]) -> DataFrame:
    """(seed, pseudo_F, R2) of permuted labels."""
    out = None
    for s in seeds:
        p = permuted(vectors, key, group, s).withColumnRenamed(key, "_k")
        v = vectors.join(p, F.col(key) == F.col("_k")).select(F.col(key), F.col("permuted"), F.col(vector))
        one = permanova(coordinates(v, key, "permuted", vector)).select(F.lit(s).alias("seed"), "pseudo_F", "R2")
        out = one if out is None else out.unionByName(one)
    return out


def permanova_pairs(long: DataFrame) -> DataFrame:
    """(group_a, group_b, n_a, n_b, pseudo_F, R2) of each pair of groups, from the groups' sums alone."""
    cell = long.groupBy("g", "d").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    a, b = (cell.select(*[F.col(c).alias(f"{c}{x}") for c in ("g", "d", "s", "q", "n")]) for x in "ab")
    both = a.join(b, (F.col("da") == F.col("db")) & (F.col("ga") < F.col("gb")))
    w = F.sum(F.col("qa") - F.col("sa") * F.col("sa") / F.col("na") + F.col("qb") - F.col("sb") * F.col("sb") / F.col("nb"))
    t = F.sum(F.col("qa") + F.col("qb") - F.pow(F.col("sa") + F.col("sb"), 2) / (F.col("na") + F.col("nb")))
    x = both.groupBy(F.col("ga").alias("group_a"), F.col("gb").alias("group_b")).agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), w.alias("w"), t.alias("t"))
    return x.select("group_a", "group_b", "n_a", "n_b", ratio(F.col("t") - F.col("w"), F.col("w") / (F.col("n_a") + F.col("n_b") - 2)).alias("pseudo_F"), ratio(F.col("t") - F.col("w"), F.col("t")).alias("R2"))


def centroid_distances(long: DataFrame) -> DataFrame:
    """(k, g, dist): distance of each row to its group's centroid."""
    c = long.groupBy(F.col("g").alias("cg"), F.col("d").alias("cd")).agg(F.avg("v").alias("m"))
    return long.join(c, (F.col("g") == F.col("cg")) & (F.col("d") == F.col("cd"))).groupBy("k", "g").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("m"), 2))).alias("dist"))


def permdisp(long: DataFrame) -> DataFrame:
    """n, groups and F of the distances to centroids."""
    return anova(centroid_distances(long).select("g", F.lit("dist").alias("feature"), F.col("dist").alias("v"))).select("n", "groups", "anova_F")


def block_rows(n: int, least: int = 500, most: int = 16_384, parts: int = 24) -> int:
    """Rows of a block where pairs of blocks are tasks: some hundred pairs, and few copies of each row, at any size."""
    return min(most, max(least, -(-n // parts)))


def energy(vectors: DataFrame, key: str, group: str, vector: str, block: int | None = None) -> DataFrame:
    """One row, energy: the k-sample energy statistic of Euclidean distances; means within a group include its zeros.

    Rows fall into blocks and a task has a pair of blocks, of which it holds some rows' distances at a time; it returns sums
    by pair of groups and no distances. A row is sent once for each block.
    """
    rows = vectors.count()
    n = max(1, -(-rows // (block or block_rows(rows))))
    rows = vectors.select(F.col(group).cast("string").alias("g"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    pairs = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("g", "v", F.col("b") == F.least("b", "o"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).toDF("g", "v", "first", "i", "j")

    def sums(t: pa.Table) -> pa.Table:
        g, first = t["g"].combine_chunks().dictionary_encode(), t["first"].to_numpy()
        names, at = g.dictionary.to_pylist(), g.indices.to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(at), -1)
        same = t["i"][0].as_py() == t["j"][0].as_py()
        a, b = (np.arange(len(at)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        total, right, norms = np.zeros((len(names), len(names))), np.eye(len(names))[at[b]], (v[b] ** 2).sum(1)
        x, y = v[a], v[b].T.copy()
        step = max(16, (1 << 18) // max(len(b), 1))
        for s in range(0, len(a), step):
            d = (x[s : s + step] ** 2).sum(1)[:, None] + norms - 2 * (x[s : s + step] @ y)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if same:
                d[np.arange(len(d)), np.arange(s, s + len(d))] = 0
            total += np.eye(len(names))[at[a[s : s + step]]].T @ (d @ right)
        total = total if same else total + total.T
        x, y = (c.ravel() for c in np.meshgrid(np.arange(len(names)), np.arange(len(names)), indexing="ij"))
        return pa.table({"ga": pa.array([names[i] for i in x], pa.string()), "gb": pa.array([names[i] for i in y], pa.string()), "s": total.ravel()})

    total = pairs.groupBy("i", "j").applyInArrow(sums, "ga string, gb string, s double").groupBy("ga", "gb").agg(F.sum("s").alias("s"))
    size = rows.groupBy("g").agg(F.count("*").alias("n"))
    na, nb = size.select(F.col("g").alias("xa"), F.col("n").alias("na")), size.select(F.col("g").alias("xb"), F.col("n").alias("nb"))
    m = total.join(na, F.col("ga") == F.col("xa")).join(nb, F.col("gb") == F.col("xb")).select("ga", "gb", "na", "nb", (F.col("s") / (F.col("na") * F.col("nb"))).alias("m"))
    own = m.where("ga = gb").select(F.col("ga").alias("o"), F.col("m").alias("w"))
    both = m.where("ga < gb").join(own.toDF("oa", "wa"), F.col("ga") == F.col("oa")).join(own.toDF("ob", "wb"), F.col("gb") == F.col("ob"))
    return both.agg(F.sum(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * (2 * F.col("m") - F.col("wa") - F.col("wb"))).alias("energy"))


def nearest(vectors: DataFrame, key: str, vector: str, metric: str, k: int = 5, each: int = 20) -> DataFrame:
    """(query, rank, neighbour, distance): the k nearest rows of every row whose key `each` divides, over all rows.

    The queries are a stated share of the rows and are held against them in blocks; a task keeps k of each query, so what
    is gathered does not grow with the pairs.
    """
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.where(F.col("k") % each == 0).count() // 2000))
    asked = rows.where(F.col("k") % each == 0).select(F.pmod("k", F.lit(blocks * each)).alias("q"), "k", "v")
    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    others = rows.select(F.pmod(F.xxhash64("k"), F.lit(int(spread))).alias("part"), "k", "v")
    left = asked.select("q", "k", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(spread) - 1).cast("long"))).alias("part"))
    right = others.select(F.explode(F.array([F.lit(i * each).cast("long") for i in range(blocks)])).alias("q"), "part", "k", "v")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a["k"].to_numpy(), b["k"].to_numpy()
        if not len(ka) or not len(kb):
            return pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        d = distances(np.array(a["v"].to_pylist(), float), np.array(b["v"].to_pylist(), float), metric)
        d[ka[:, None] == kb] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
        r = np.repeat(np.arange(len(ka)), order.shape[1])
        dist = d[r, order.reshape(-1)]
        ok = np.isfinite(dist)
        return pa.table({"query": ka[r][ok], "neighbour": kb[order.reshape(-1)][ok], "distance": dist[ok]})

    found = left.groupBy("q", "part").cogroup(right.groupBy("q", "part")).applyInArrow(best, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "distance")


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """euclidean, cityblock, cosine or correlation; what is not defined is zero."""
    if metric == "cityblock":
        return np.stack([np.abs(x - b).sum(1) for x in a])
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    if metric == "correlation":
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    elif metric != "cosine":
        raise ValueError(f"metric {metric!r} is not known")
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(1 - (a / np.sqrt((a * a).sum(1))[:, None]) @ (b / np.sqrt((b * b).sum(1))[:, None]).T)


# --- univariate ------------------------------------------------------------------------------------------------------


def group_statistics(long: DataFrame) -> DataFrame:
    """(feature, g, n, mean, sd) of (g, feature, v); sample deviation."""
    return long.groupBy("feature", "g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def anova(long: DataFrame) -> DataFrame:
    """(feature, n, groups, anova_F, eta2), from the groups' moments."""
    cell = long.groupBy("feature", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = cell.groupBy(F.col("feature").alias("f")).agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    x = cell.join(grand, F.col("feature") == F.col("f")).groupBy("feature").agg(F.max("rows").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("centre"), 2)).alias("b"), F.sum(F.col("n") * F.col("s")).alias("w"))
    return x.select("feature", "n", "groups", ratio(F.col("b") / (F.col("groups") - 1), F.col("w") / (F.col("n") - F.col("groups"))).alias("anova_F"), ratio(F.col("b"), F.col("b") + F.col("w")).alias("eta2"))


def kruskal(long: DataFrame) -> DataFrame:
    """(feature, n, groups, kruskal_H, epsilon2), with ties corrected. Equal values are ranked together: values are counted
    first, so a window holds the distinct values of a feature."""
    values = long.groupBy("feature", "v").agg(F.count("*").alias("t"))
    w = Window.partitionBy("feature").orderBy("v")
    ranked = values.withColumn("rank", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("t") - 1) / 2)
    ties = ranked.groupBy(F.col("feature").alias("tf")).agg(F.sum("t").alias("N"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    r = long.join(ranked.toDF("rf", "rv", "t", "rank"), (F.col("feature") == F.col("rf")) & (F.col("v") == F.col("rv"))).groupBy("feature", "g").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    x = r.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("groups")).join(ties, F.col("feature") == F.col("tf"))
    n = F.col("N").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return x.select("feature", F.col("N").alias("n"), "groups", h.alias("kruskal_H"), ((h - F.col("groups") + 1) / (n - F.col("groups"))).alias("epsilon2"))


def pair_effects(long: DataFrame) -> DataFrame:
    """(feature, group_a, group_b, n_a, n_b, difference, cohen_d, hedges_g) of each pair of groups, from moments."""
    s = long.groupBy("feature", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    a, b = (s.select(*[F.col(c).alias(f"{c}_{x}") for c in ("feature", "g", "n", "m", "s")]) for x in "ab")
    x = a.join(b, (F.col("feature_a") == F.col("feature_b")) & (F.col("g_a") < F.col("g_b")))
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("s_a") + (F.col("n_b") - 1) * F.col("s_b")) / df)
    d = ratio(F.col("m_b") - F.col("m_a"), pooled)
    return x.select(F.col("feature_a").alias("feature"), F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), "n_a", "n_b", (F.col("m_b") - F.col("m_a")).alias("difference"), d.alias("cohen_d"), (d * (1 - 3 / (4 * df - 1))).alias("hedges_g"))


def cliffs_delta(long: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, cliffs_delta): P(b > a) - P(a > b), by counts of values below, never by pairs."""
    v = long.where(F.col("g").isin(a, b)).groupBy("feature", "v").agg(F.count(F.when(F.col("g") == a, 1)).alias("a"), F.count(F.when(F.col("g") == b, 1)).alias("b"))
    w = Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    below = v.withColumns({"a_below": F.coalesce(F.sum("a").over(w), F.lit(0)), "b_below": F.coalesce(F.sum("b").over(w), F.lit(0))})
    return below.groupBy("feature").agg(ratio((F.sum(F.col("b") * F.col("a_below")) - F.sum(F.col("a") * F.col("b_below"))).cast("double"), (F.sum("a") * F.sum("b")).cast("double")).alias("cliffs_delta"))


def false_discovery(table: DataFrame, p: str = "p", key: str = "key") -> DataFrame:
    """table with q: Benjamini-Hochberg over the rows whose p is not null."""
    w = Window.partitionBy(F.col(p).isNull()).orderBy(F.desc(p), F.desc(key))
    n, rank = F.count(p).over(Window.partitionBy()), F.row_number().over(Window.partitionBy(F.col(p).isNull()).orderBy(p, key))
    t = table.withColumns({"_n": n, "_rank": rank})
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    return t.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(w)))).drop("_n", "_rank")


# --- agreement of two labellings -------------------------------------------------------------------------------------


def confusion(pairs: DataFrame) -> DataFrame:
    """(y, p, n) of (y, p)."""
    return pairs.groupBy("y", "p").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy, kappa, ari, nmi, purity; all from the contingency table."""
    c = confusion(pairs)
    by_y = c.groupBy(F.col("y").alias("yy")).agg(F.sum("n").alias("ny"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = c.groupBy(F.col("p").alias("pp")).agg(F.sum("n").alias("np"), F.max("n").alias("top"))
    two = lambda x: x * (x - 1) / 2
    y = by_y.agg(F.sum("ny").alias("n"), F.sum("hit").alias("hit"), F.avg(F.col("hit") / F.col("ny")).alias("balanced_accuracy"), F.sum(two(F.col("ny"))).alias("cy"))
    p = by_p.agg(F.sum(two(F.col("np"))).alias("cp"), F.sum("top").alias("top"))
    joint = c.join(by_y, F.col("y") == F.col("yy")).join(by_p, F.col("p") == F.col("pp"))
    total = F.sum("n").over(Window.partitionBy())
    j = joint.withColumn("all_rows", total.cast("double")).agg(F.sum(two(F.col("n"))).alias("cj"), F.sum(F.col("n") / F.col("all_rows") * F.log(F.col("n") * F.col("all_rows") / (F.col("ny") * F.col("np")))).alias("mi"))
    hy, hp = (t.withColumn("all_rows", F.sum(c).over(Window.partitionBy()).cast("double")).agg((-F.sum(F.col(c) / F.col("all_rows") * F.log(F.col(c) / F.col("all_rows")))).alias(h)) for t, c, h in ((by_y, "ny", "hy"), (by_p, "np", "hp")))
    chance = by_y.join(by_p, F.col("yy") == F.col("pp")).agg(F.coalesce(F.sum(F.col("ny").cast("double") * F.col("np")), F.lit(0.0)).alias("e"))
    x = y.crossJoin(p).crossJoin(j).crossJoin(hy).crossJoin(hp).crossJoin(chance)
    n = F.col("n").cast("double")
    expected = F.col("cy") * F.col("cp") / two(n)
    return x.select((F.col("hit") / n).alias("accuracy"), "balanced_accuracy", ratio(F.col("hit") / n - F.col("e") / (n * n), 1 - F.col("e") / (n * n)).alias("kappa"), ratio(F.col("cj") - expected, (F.col("cy") + F.col("cp")) / 2 - expected).alias("ari"), ratio(2 * F.col("mi"), F.col("hy") + F.col("hp")).alias("nmi"), (F.col("top") / n).alias("purity"))

