"""Queries on groups: lineitem (flags crossed with statuses) and embeddings (by label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare as prep
from ..operators import statistics as st
from .tracks import r, rounded

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEEDS = list(range(1, 10))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", *FEATURES)
    return prep.cleaned(t, FEATURES)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with some values missing by rule."""
    return lineitem(spark, sf_dir).withColumns({"l_tax": F.when(F.col("l_partkey") % 10 != 0, F.col("l_tax")), "l_discount": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_discount"))})


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.long_form(lineitem(spark, sf_dir), FEATURES, "l_returnflag").withColumnRenamed("l_returnflag", "g")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.coordinates(vectors(spark, sf_dir), "vec_id", "label", "embedding")


KEYS = ["l_orderkey", "l_linenumber"]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS g, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in FEATURES) + ")"
GAPS = "gaps AS (SELECT * REPLACE (CASE WHEN l_partkey % 10 <> 0 THEN l_tax END AS l_tax, CASE WHEN l_suppkey % 7 <> 0 THEN l_discount END AS l_discount) FROM lineitem)"
VECTORS = "long AS (SELECT vec_id AS k, label AS g, unnest(range(0, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CELL = f"{VECTORS}, cell AS (SELECT g, d, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM long GROUP BY g, d)"


def _each(template: str, digits: int = 6) -> str:
    return ", ".join(r(template.replace("{c}", c), c, digits) for c in FEATURES)


def _scaled(stats: str, template: str) -> str:
    inner = ", ".join(stats.replace("{c}", c) for c in FEATURES)
    return f"WITH s AS (SELECT {inner} FROM lineitem) SELECT l_orderkey, l_linenumber, {_each(template)} FROM lineitem, s"


def _permanova_sql(source: str) -> str:
    return f"""SELECT seed, {r('((t - w) / (k - 1)) / (w / (n - k))', 'pseudo_F')}, {r('(t - w) / t', 'R2')} FROM (SELECT seed, sum(q - s * s / n) AS w, count(DISTINCT g) AS k FROM {source} GROUP BY seed) JOIN
 (SELECT seed, sum(q - s * s / n) AS t, max(n) AS n FROM (SELECT seed, d, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM {source} GROUP BY seed, d) GROUP BY seed) USING (seed)"""


NULLS = f"""{VECTORS}, seeds AS (SELECT unnest(range(1, 10)) AS seed),
a AS (SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, '|', vec_id))) AS n FROM embeddings, seeds),
b AS (SELECT label, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
p AS (SELECT seed, vec_id, b.label AS g FROM a JOIN b USING (n)),
cells AS (SELECT seed, p.g AS g, d, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM long JOIN p ON k = vec_id GROUP BY seed, p.g, d)"""
_PAIR = {
    "euclidean": "sqrt(sum(pow(a.v - b.v, 2)))", "cityblock": "sum(abs(a.v - b.v))", "cosine": "1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))", "correlation": "1 - corr(a.v, b.v)",
}
DIST = {m: f"WITH {VECTORS}, p AS (SELECT a.k AS query, b.k AS neighbour, {e} AS distance FROM long a JOIN long b ON a.d = b.d WHERE a.k % 20 = 0 AND a.k <> b.k GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM p) SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, {r('distance', 'distance')} FROM o WHERE rank <= 5" for m, e in _PAIR.items()}
PAIRS = "pairs AS (SELECT quality AS y, toxic AS p FROM labels)"
LABELLED = "pairs AS (SELECT l_returnflag AS y, l_linestatus AS p FROM lineitem)"


def _agreement_sql(source: str) -> str:
    return f"""WITH {source}, c AS (SELECT y, p, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY y, p), cy AS (SELECT y, sum(n) AS ny, sum(n) FILTER (y = p) AS hit FROM c GROUP BY y), cp AS (SELECT p, sum(n) AS np, max(n) AS top FROM c GROUP BY p), t AS (SELECT sum(n) AS n FROM c),
x AS (SELECT (SELECT n FROM t) AS n, (SELECT coalesce(sum(hit), 0) FROM cy) AS hit, (SELECT avg(coalesce(hit, 0) / ny) FROM cy) AS ba, (SELECT sum(ny * (ny - 1) / 2) FROM cy) AS sy, (SELECT sum(np * (np - 1) / 2) FROM cp) AS sp, (SELECT sum(n * (n - 1) / 2) FROM c) AS sj,
(SELECT sum(c.n / t.n * ln(c.n * t.n / (ny * np))) FROM c JOIN cy USING (y) JOIN cp USING (p), t) AS mi, (SELECT -sum(ny / n * ln(ny / n)) FROM cy, t) AS hy, (SELECT -sum(np / n * ln(np / n)) FROM cp, t) AS hp, (SELECT coalesce(sum(ny * np), 0) FROM cy JOIN cp ON y = p) AS e, (SELECT sum(top) FROM cp) AS top)
SELECT {r('hit / n', 'accuracy')}, {r('ba', 'balanced_accuracy')}, {r('(hit / n - e / (n * n)) / (1 - e / (n * n))', 'kappa')}, {r('(sj - sy * sp / (n * (n - 1) / 2)) / ((sy + sp) / 2 - sy * sp / (n * (n - 1) / 2))', 'ari')}, {r('2 * mi / (hy + hp)', 'nmi')}, {r('top / n', 'purity')} FROM x"""


ANOVA = f"{LONG}, cell AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_pop(v) AS s, var_samp(v) AS s1 FROM long GROUP BY feature, g), grand AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS mm FROM cell GROUP BY feature), x AS (SELECT feature, max(nn) AS n, count(*) AS groups, sum(n * pow(m - mm, 2)) AS b, sum(n * s) AS w FROM cell JOIN grand USING (feature) GROUP BY feature)"
KRUSKAL = f"{LONG}, k AS (SELECT feature, v, count(*) AS t FROM long GROUP BY ALL), k2 AS (SELECT *, sum(t) OVER (PARTITION BY feature ORDER BY v) - (t - 1) / 2 AS rank FROM k), s AS (SELECT feature, g, sum(rank) AS s, count(*) AS n FROM long JOIN k2 USING (feature, v) GROUP BY ALL), ti AS (SELECT feature, CAST(sum(t) AS DOUBLE) AS n, sum(pow(CAST(t AS DOUBLE), 3) - t) AS ties FROM k GROUP BY feature), x AS (SELECT feature, ti.n AS n, count(*) AS groups, (12 / (ti.n * (ti.n + 1)) * sum(s * s / s.n) - 3 * (ti.n + 1)) / (1 - any_value(ties) / (ti.n * ti.n * ti.n - ti.n)) AS h FROM s JOIN ti USING (feature) GROUP BY feature, ti.n)"
PAIRWISE = f"{ANOVA}, e AS (SELECT a.feature AS feature, a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, b.m - a.m AS difference, (b.m - a.m) / sqrt(((a.n - 1) * a.s1 + (b.n - 1) * b.s1) / (a.n + b.n - 2)) AS d FROM cell a JOIN cell b ON a.feature = b.feature AND a.g < b.g)"

SQL = {
    "scale_zscore": _scaled("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}", "({c} - m_{c}) / s_{c}"),
    "scale_minmax": _scaled("min({c}) AS m_{c}, max({c}) - min({c}) AS s_{c}", "({c} - m_{c}) / s_{c}"),
    "scale_robust": _scaled("quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}", "({c} - m_{c}) / s_{c}"),
    "scale_rank": f"SELECT l_orderkey, l_linenumber, {_each('(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 - 0.5) / count(*) OVER ()')} FROM lineitem",
    "winsorise": _scaled("quantile_cont({c}, 0.05) AS m_{c}, quantile_cont({c}, 0.95) AS s_{c}", "greatest(least({c}, s_{c}), m_{c})"),
    "impute_median": f"WITH {GAPS}, s AS (SELECT quantile_cont(l_tax, 0.5) AS t, quantile_cont(l_discount, 0.5) AS d FROM gaps) SELECT l_orderkey, l_linenumber, {r('coalesce(l_tax, t)', 'l_tax')}, {r('coalesce(l_discount, d)', 'l_discount')} FROM gaps, s",
    "drop_sample": f"WITH {GAPS} SELECT l_orderkey, l_linenumber, {_each('{c}')} FROM gaps WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL",
    "drop_feature": f"SELECT l_orderkey, l_linenumber, {r('l_quantity', 'l_quantity')}, {r('l_extendedprice', 'l_extendedprice')} FROM lineitem",
    "drop_constant": f"SELECT l_orderkey, l_linenumber, {_each('{c}')} FROM lineitem",
    "feature_summary": f"WITH {LONG} SELECT feature, count(v) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'sd')}, {r('median(v)', 'median')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM long GROUP BY feature",
    "collinear_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]),
    "collinear_prune": f"SELECT l_orderkey, l_linenumber, {_each('{c}')} FROM lineitem",
    "feature_weights": f"SELECT l_orderkey, l_linenumber, {r('l_quantity * 2.0', 'l_quantity')}, {r('l_tax * 0.5', 'l_tax')} FROM lineitem",
    "inverse_scale": f"SELECT l_orderkey, l_linenumber, {r('l_quantity / 2.0 * 3.0 + 1.0', 'l_quantity')} FROM lineitem",
    "onehot_groups": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(l_returnflag = '{v}' AS INTEGER) AS is_{v}" for v in "ANR") + " FROM lineitem",
    "group_codes": "SELECT l_returnflag AS \"group\", CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)",
    "block_design": "WITH a AS (SELECT l_linestatus, count(DISTINCT l_returnflag) AS g FROM lineitem GROUP BY 1), b AS (SELECT count(*) AS replicates, count(*) FILTER (g = 1) AS pure FROM a) SELECT *, CASE WHEN replicates < 2 THEN 'none' WHEN pure = replicates THEN 'nested' WHEN pure = 0 THEN 'crossed' ELSE 'mixed' END AS design FROM b",
    "block_design_nested": "WITH a AS (SELECT user_id % 12 AS r, count(DISTINCT (user_id % 12) % 4) AS g FROM events GROUP BY 1), b AS (SELECT count(*) AS replicates, count(*) FILTER (g = 1) AS pure FROM a) SELECT *, CASE WHEN replicates < 2 THEN 'none' WHEN pure = replicates THEN 'nested' WHEN pure = 0 THEN 'crossed' ELSE 'mixed' END AS design FROM b",
    "unit_means": f"WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS o FROM c) WHERE o = 1), a AS (SELECT l_suppkey, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} FROM lineitem GROUP BY 1) SELECT l_suppkey, l_returnflag, {_each('{c}')} FROM a JOIN m USING (l_suppkey)",
    "permute_free": "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat('7|', vec_id))) AS n FROM embeddings), b AS (SELECT label, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) SELECT vec_id, label AS permuted FROM a JOIN b USING (n)",
    "permute_crossed": "WITH a AS (SELECT vec_id, vec_id % 4 AS w, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY md5(concat('7|', vec_id))) AS n FROM embeddings), b AS (SELECT label, vec_id % 4 AS w, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS n FROM embeddings) SELECT vec_id, label AS permuted FROM a JOIN b USING (w, n)",
    "permute_nested": "WITH u AS (SELECT CAST(user_id % 12 AS VARCHAR) AS r, min(CAST((user_id % 12) % 4 AS VARCHAR)) AS g FROM events GROUP BY 1), a AS (SELECT r, row_number() OVER (ORDER BY md5(concat('7|', r))) AS n FROM u), b AS (SELECT g, row_number() OVER (ORDER BY r) AS n FROM u), p AS (SELECT r, g FROM a JOIN b USING (n)) SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid, p.g AS permuted FROM events JOIN p ON r = CAST(user_id % 12 AS VARCHAR)",
    "permanova_euclidean": f"WITH {CELL}, x AS (SELECT (SELECT sum(q - s * s / n) FROM cell) AS w, (SELECT sum(q - s * s / n) FROM (SELECT sum(s) AS s, sum(q) AS q, sum(n) AS n FROM cell GROUP BY d)) AS t, (SELECT max(n) FROM (SELECT sum(n) AS n FROM cell GROUP BY d)) AS n, (SELECT count(DISTINCT g) FROM cell) AS groups) SELECT CAST(n AS BIGINT) AS n, groups, {r('((t - w) / (groups - 1)) / (w / (n - groups))', 'pseudo_F')}, {r('(t - w) / t', 'R2')} FROM x",
    "permanova_null": f"WITH {NULLS} {_permanova_sql('cells')}",
    "permanova_perm_p": f"WITH {NULLS}, f AS ({_permanova_sql('cells')}), o AS (SELECT sum(q - s * s / n) AS w, count(DISTINCT g) AS k FROM (SELECT g, d, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM long GROUP BY g, d)), t AS (SELECT sum(q - s * s / n) AS t, max(n) AS n FROM (SELECT d, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM long GROUP BY d)) SELECT {r('(1.0 + (SELECT count(*) FROM f WHERE pseudo_F >= round(((t - w) / (k - 1)) / (w / (n - k)), 6))) / 10', 'p')} FROM o, t",
    "permanova_pairwise": f"WITH {CELL}, x AS (SELECT a.g AS group_a, b.g AS group_b, max(a.n) AS n_a, max(b.n) AS n_b, sum(a.q - a.s * a.s / a.n + b.q - b.s * b.s / b.n) AS w, sum(a.q + b.q - pow(a.s + b.s, 2) / (a.n + b.n)) AS t FROM cell a JOIN cell b ON a.d = b.d AND a.g < b.g GROUP BY 1, 2) SELECT group_a, group_b, n_a, n_b, {r('(t - w) / (w / (n_a + n_b - 2))', 'pseudo_F')}, {r('(t - w) / t', 'R2')} FROM x",
    "centroid_distances": f"WITH {VECTORS}, c AS (SELECT g, d, avg(v) AS m FROM long GROUP BY g, d) SELECT k, g, {r('sqrt(sum(pow(v - m, 2)))', 'dist')} FROM long JOIN c USING (g, d) GROUP BY k, g",
    "permdisp_euclidean": f"WITH {VECTORS}, c AS (SELECT g, d, avg(v) AS m FROM long GROUP BY g, d), z AS (SELECT k, g, sqrt(sum(pow(v - m, 2))) AS v FROM long JOIN c USING (g, d) GROUP BY k, g), s AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM z GROUP BY g), x AS (SELECT sum(n) AS n, count(*) AS k, sum(n * pow(m - (SELECT avg(v) FROM z), 2)) AS b, sum(n * s) AS w FROM s) SELECT CAST(n AS BIGINT) AS n, k AS groups, {r('(b / (k - 1)) / (w / (n - k))', 'anova_F')} FROM x",
    "energy_statistic": f"WITH {VECTORS}, p AS (SELECT a.k AS ka, b.k AS kb, a.g AS ga, b.g AS gb, sqrt(sum(pow(a.v - b.v, 2))) AS dist FROM long a JOIN long b ON a.d = b.d GROUP BY ALL), m AS (SELECT ga, gb, avg(dist) AS m FROM p GROUP BY ga, gb), s AS (SELECT label AS g, count(*) AS n FROM embeddings GROUP BY 1) SELECT {r('sum(a.n * b.n / CAST(a.n + b.n AS DOUBLE) * (2 * m.m - wa.m - wb.m))', 'energy')} FROM m JOIN s a ON a.g = ga JOIN s b ON b.g = gb JOIN m wa ON wa.ga = m.ga AND wa.gb = m.ga JOIN m wb ON wb.ga = m.gb AND wb.gb = m.gb WHERE m.ga < m.gb",
    **{f"dist_{m}": s for m, s in DIST.items()},
    "univariate_stats": f"WITH {LONG} SELECT feature, g, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')} FROM long GROUP BY feature, g",
    "anova_F": f"WITH {ANOVA} SELECT feature, CAST(n AS BIGINT) AS n, groups, {r('(b / (groups - 1)) / (w / (n - groups))', 'anova_F')} FROM x",
    "eta_squared": f"WITH {ANOVA} SELECT feature, round(b / (b + w), 9) AS eta2 FROM x",
    "kruskal_H": f"WITH {KRUSKAL} SELECT feature, CAST(n AS BIGINT) AS n, groups, {r('h', 'kruskal_H', 5)} FROM x",
    "epsilon_squared": f"WITH {KRUSKAL} SELECT feature, round((h - groups + 1) / (n - groups), 9) + 0.0 AS epsilon2 FROM x",
    "hedges_g": f"WITH {PAIRWISE} SELECT feature, group_a, group_b, n_a, n_b, {r('difference', 'difference')}, {r('d', 'cohen_d')}, {r('d * (1 - 3 / (4 * (n_a + n_b - 2) - 1.0))', 'hedges_g')} FROM e",
    "cohen_max": f"WITH {PAIRWISE} SELECT feature, {r('max(abs(d))', 'max_abs_cohen_d')} FROM e GROUP BY feature",
    "cliffs_delta": f"WITH {LONG}, c AS (SELECT feature, v, count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'R') AS b FROM long WHERE g IN ('A', 'R') GROUP BY ALL), w AS (SELECT *, coalesce(sum(a) OVER o, 0) AS ab, coalesce(sum(b) OVER o, 0) AS bb FROM c WINDOW o AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT feature, {r('CAST(sum(b * ab) - sum(a * bb) AS DOUBLE) / CAST(sum(a) * sum(b) AS DOUBLE)', 'cliffs_delta')} FROM w GROUP BY feature",
    "bh_fdr": f"WITH s AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 <> 0 THEN (p_retailprice - floor(p_retailprice)) * 0.5 + (p_partkey % 97) / 194.0 END AS p FROM part), o AS (SELECT *, count(p) OVER () AS n, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, key) AS rank FROM s), q AS (SELECT *, min(p * n / rank) OVER (PARTITION BY p IS NULL ORDER BY rank DESC) AS m FROM o) SELECT key, {r('p', 'p')}, {r('CASE WHEN p IS NOT NULL THEN least(1.0, m) END', 'q')} FROM q",
    "confusion_matrix": f"WITH {PAIRS} SELECT y, p, count(*) AS n FROM pairs GROUP BY y, p",
    "label_agreement": _agreement_sql(PAIRS),
    "group_agreement": _agreement_sql(LABELLED),
}


def _pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    v = (F.col("p_retailprice") - F.floor("p_retailprice")) * 0.5 + (F.col("p_partkey") % 97) / 194.0
    return p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 11 != 0, v).alias("p"))


def _permanova_p(s: SparkSession, d: str) -> DataFrame:
    seen = st.permanova(coordinates(s, d)).select(F.round("pseudo_F", 6).alias("o"))
    null = st.permanova_null(vectors(s, d), "vec_id", "label", "embedding", SEEDS)
    return null.crossJoin(seen).agg(((1 + F.count(F.when(F.round("pseudo_F", 6) >= F.col("o"), 1))) / (1 + F.count("*"))).alias("p"))


def queries() -> dict:
    def keyed(build):
        return lambda s, d: rounded(build(s, d))

    rows = lambda t, *c: t.select(*KEYS, *(c or FEATURES))
    li, lo = lineitem, long
    pairs = lambda s, d: s.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))
    flags = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("y"), F.col("l_linestatus").alias("p"))
    from . import tracks

    out = {
        **{f"scale_{k}": (lambda s, d, k=k: rows(prep.scaled(li(s, d), FEATURES, k))) for k in ("zscore", "minmax", "robust", "rank")},
        "winsorise": lambda s, d: rows(prep.winsorised(li(s, d), FEATURES, 0.05)),
        "impute_median": lambda s, d: rows(prep.imputed(gaps(s, d), ["l_tax", "l_discount"]), "l_tax", "l_discount"),
        "drop_sample": lambda s, d: rows(prep.complete_rows(gaps(s, d), FEATURES)),
        "drop_feature": lambda s, d: rows(gaps(s, d), *prep.complete_features(gaps(s, d), FEATURES)),
        "drop_constant": lambda s, d: rows((t := li(s, d).withColumn("one", F.lit(1.0))), *prep.varying(t, [*FEATURES, "one"])),
        "feature_summary": lambda s, d: prep.summary(li(s, d), FEATURES),
        "collinear_pairs": lambda s, d: prep.correlations(li(s, d), FEATURES),
        "collinear_prune": lambda s, d: rows((t := li(s, d).withColumn("copy", F.col("l_tax") * 2 + 1)), *prep.uncorrelated(t, [*FEATURES, "copy"])),
        "feature_weights": lambda s, d: rows(prep.weighted(li(s, d), {"l_quantity": 2.0, "l_tax": 0.5}), "l_quantity", "l_tax"),
        "inverse_scale": lambda s, d: rows(prep.inverse(li(s, d), ["l_quantity"], {"l_quantity": 1.0}, {"l_quantity": 3.0}, {"l_quantity": 2.0}), "l_quantity"),
        "onehot_groups": lambda s, d: rows(prep.one_hot(li(s, d), "l_returnflag", list("ANR")), "is_A", "is_N", "is_R"),
        "group_codes": lambda s, d: prep.group_codes(li(s, d), "l_returnflag"),
        "block_design": lambda s, d: st.design(li(s, d), "l_returnflag", "l_linestatus"),
        "block_design_nested": lambda s, d: st.design(tracks.spots(s, d), "group", "replicate"),
        "unit_means": lambda s, d: st.unit_means(li(s, d), FEATURES, "l_returnflag", "l_suppkey").select("l_suppkey", "l_returnflag", *FEATURES),
        "permute_free": lambda s, d: st.permuted(vectors(s, d), "vec_id", "label", 7),
        "permute_crossed": lambda s, d: st.permuted(vectors(s, d).withColumn("w", F.col("vec_id") % 4), "vec_id", "label", 7, within="w"),
        "permute_nested": lambda s, d: st.permuted(tracks.spots(s, d).select("uid", "group", "replicate").distinct(), "uid", "group", 7, unit="replicate"),
        "permanova_euclidean": lambda s, d: st.permanova(coordinates(s, d)),
        "permanova_null": lambda s, d: st.permanova_null(vectors(s, d), "vec_id", "label", "embedding", SEEDS),
        "permanova_perm_p": _permanova_p,
        "permanova_pairwise": lambda s, d: st.permanova_pairs(coordinates(s, d)),
        "centroid_distances": lambda s, d: st.centroid_distances(coordinates(s, d)),
        "permdisp_euclidean": lambda s, d: st.permdisp(coordinates(s, d)),
        "energy_statistic": lambda s, d: st.energy(vectors(s, d), "vec_id", "label", "embedding"),
        **{f"dist_{m}": (lambda s, d, m=m: st.nearest(vectors(s, d), "vec_id", "embedding", m)) for m in DIST},
        "univariate_stats": lambda s, d: st.group_statistics(lo(s, d)),
        "anova_F": lambda s, d: st.anova(lo(s, d)).drop("eta2"),
        "kruskal_H": lambda s, d: st.kruskal(lo(s, d)).select("feature", "n", "groups", F.round("kruskal_H", 5).alias("kruskal_H")),
        "hedges_g": lambda s, d: st.pair_effects(lo(s, d)),
        "cohen_max": lambda s, d: st.pair_effects(lo(s, d)).groupBy("feature").agg(F.max(F.abs("cohen_d")).alias("max_abs_cohen_d")),
        "cliffs_delta": lambda s, d: st.cliffs_delta(lo(s, d), "A", "R"),
        "bh_fdr": lambda s, d: st.false_discovery(_pvalues(s, d)),
        "confusion_matrix": lambda s, d: st.confusion(pairs(s, d)),
        "label_agreement": lambda s, d: st.agreement(pairs(s, d)),
        "group_agreement": lambda s, d: st.agreement(flags(s, d)),
    }
    return {k: keyed(q) for k, q in out.items()} | {
        "eta_squared": lambda s, d: st.anova(lo(s, d)).select("feature", F.round("eta2", 9).alias("eta2")),
        "epsilon_squared": lambda s, d: st.kruskal(lo(s, d)).select("feature", F.round("epsilon2", 9).alias("epsilon2")),
    }
