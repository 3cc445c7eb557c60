"""Queries of maps, layouts and classifiers over embeddings, and of whole-series track metrics over events.

What is linear in the rows comes from moments of any number of them, and batch and supervised maps of over LIMIT rows are
trained on rows; layouts of more rows work by blocks. The other dense methods take up to LIMIT rows and raise beyond.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SomConfig, StatsConfig
from ..functions.special import f_tail
from ..operators import classify as cl
from ..operators import geodesic
from ..operators import linear as ln
from ..operators import ordination as od
from ..operators import pairs
from ..operators import projection as pr
from ..operators import ranked as rk
from ..operators import resampled as rs
from ..operators import registry, scan, som
from ..operators import statistics as st
from ..operators import track_arrays
from . import tracks
from .groups import VECTORS, coordinates, lineitem, vectors
from .tracks import r, rounded

WIDTH, HEIGHT = 4, 3
GRID = som.Lattice.grid(WIDTH, HEIGHT)
LATTICE = f"node AS (SELECT CAST(i AS INTEGER) AS node, CAST(i % {WIDTH} AS INTEGER) AS col, CAST(i // {WIDTH} AS INTEGER) AS row, i % {WIDTH} + 0.5 * ((i // {WIDTH}) % 2) AS x, (i // {WIDTH}) * sqrt(3) / 2 AS y FROM range({WIDTH * HEIGHT}) t(i)), adj AS (SELECT a.node AS a, b.node AS b FROM node a JOIN node b ON a.node <> b.node AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.05 * 1.0 + 1e-9)"
BMU = f"""{VECTORS}, {LATTICE}, w AS (SELECT k AS node, d, v AS w FROM long WHERE k < {WIDTH * HEIGHT}),
dd AS (SELECT k, node, sqrt(sum(pow(v - w, 2))) AS dist FROM long JOIN w USING (d) GROUP BY k, node), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(dist, 9), node) AS n FROM dd),
bmu AS (SELECT a.k AS vec_id, CAST(a.node AS INTEGER) AS bmu, a.dist AS bmu_distance, CAST(b.node AS INTEGER) AS runner_up, b.dist AS runner_up_distance, label AS g FROM o a JOIN o b ON a.k = b.k AND a.n = 1 AND b.n = 2 JOIN embeddings e ON e.vec_id = a.k),
h AS (SELECT bmu AS node, g, count(*) AS hits FROM bmu GROUP BY ALL)"""
LAYOUT = f"""{VECTORS}, px AS (SELECT a.k AS i, b.k AS j, sum(pow(a.v - b.v, 2)) AS x, sum(CASE WHEN a.d < 2 THEN pow(a.v - b.v, 2) ELSE 0 END) AS y FROM long a JOIN long b ON a.d = b.d WHERE a.k <> b.k GROUP BY 1, 2),
rk AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY x, j) AS rx, row_number() OVER (PARTITION BY i ORDER BY y, j) AS ry FROM px), n AS (SELECT count(*) AS n, CAST(greatest(3, least(12, count(*) // 10)) AS DOUBLE) AS k FROM embeddings)"""


def matrix(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and labels in the order of ids; at most LIMIT rows."""
    rows = vectors(spark, sf_dir).orderBy("vec_id").limit(pr.LIMIT + 1).collect()
    return np.array([x[0] for x in rows]), pr.limited(np.array([x[2] for x in rows], float)), np.array([x[1] for x in rows])


def codebook(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The vectors of the smallest ids, one a node."""
    return np.array([x[0] for x in vectors(spark, sf_dir).orderBy("vec_id").limit(WIDTH * HEIGHT).select("embedding").collect()], float)


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    a = som.assigned(v, "vec_id", "embedding", codebook(spark, sf_dir))
    return a.join(v.select(F.col("vec_id").alias("id"), F.col("label").alias("g")), F.col("vec_id") == F.col("id")).drop("id")


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return assignment(s, d).select("vec_id", "bmu", F.round("bmu_distance", 5).alias("bmu_distance"), "runner_up")


def _u_matrix(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, float(u)) for i, u in enumerate(som.u_matrix(codebook(s, d), GRID))], "node int, u double")


def _node_profile(s: SparkSession, d: str) -> DataFrame:
    a = assignment(s, d).select("vec_id", "bmu")
    return coordinates(s, d).where("d < 4").join(a, F.col("k") == F.col("vec_id")).groupBy(F.col("bmu").alias("node"), "d").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def _gradients(s: SparkSession, d: str) -> DataFrame:
    h = {x["bmu"]: x["n"] for x in assignment(s, d).groupBy("bmu").agg(F.count("*").alias("n")).collect()}
    w = codebook(s, d)
    rows = som.gradients(w, GRID, np.array([h.get(i, 0) for i in range(len(w))]), [f"f{i}" for i in range(w.shape[1])])
    return s.createDataFrame(rows, "feature string, angle_deg double, magnitude double, plane_r2 double")


def _ranks(s: SparkSession, d: str, curve: bool = True) -> dict:
    try:
        _, x, _ = matrix(s, d)
    except pr.TooManyRows:
        return rk.quality(vectors(s, d), "vec_id", "embedding", 2, curve=curve)
    return pr.rank_quality(x, x[:, :2])


def _rnx(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i + 1, float(v)) for i, v in enumerate(_ranks(s, d)["rnx"])], "K int, rnx double")


def _on_rows(s: SparkSession, d: str, kind: str) -> som.Map:
    """A map of more rows than a matrix may have, its epochs as passes over the rows."""
    if kind in ("online", "growing"):
        return {"online": scan.online, "growing": scan.growing}[kind](vectors(s, d), "vec_id", "embedding", SomConfig(algorithm=kind))
    v, cfg = vectors(s, d), SomConfig(epochs=20)
    if kind == "batch":
        return _finished(scan.maps(v, "embedding", [{}], cfg)[0])
    low, high, wide = v.where("label is not null").agg(F.min("label"), F.max("label"), F.max(F.size("embedding"))).first()
    if low == high:
        return _on_rows(s, d, "batch")
    if kind == "relevance":
        return scan.relevance(v, "embedding", "label", SomConfig(algorithm=kind, epochs=20))
    a, k = cfg.label_weight, int(high) + 1
    scale = float(np.sqrt((1 - a) / wide))
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("label"), float(np.sqrt(a / k))).otherwise(0.0))
    both = v.select(F.concat(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale), own).alias("x"))
    m = _finished(scan.maps(both, "x", [{}], cfg)[0])
    return som.Map(m.codebook[:, :wide] / scale, m.lattice, m.history)


def _finished(cell: scan.Cell) -> som.Map:
    if cell.error:
        raise RuntimeError(cell.error)
    return cell.map


def _trained(kind: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        try:
            ids, x, y = matrix(s, d)
        except pr.TooManyRows:
            book = _on_rows(s, d, kind).codebook
            return som.assigned(vectors(s, d), "vec_id", "embedding", book).select("vec_id", F.col("bmu").alias("node"))
        m = som.trained(x, SomConfig(algorithm=kind, epochs=20) if kind in ("batch", "supervised", "relevance") else SomConfig(algorithm=kind), y)
        node = som.two_nearest(x, m.codebook)[0]
        return s.createDataFrame([(int(i), int(n)) for i, n in zip(ids, node, strict=True)], "vec_id long, node int")

    return query


def _signed(axes: DataFrame) -> DataFrame:
    """The real axes beside each other; an axis' largest coordinate is positive, as in projection.signed."""
    y = axes.where("not imaginary").groupBy("key").agg(*[F.sum(F.when(F.col("axis") == i, F.col("coordinate")).otherwise(0.0)).alias(f"axis{i}") for i in (1, 2)]).checkpoint()
    ends = y.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in ("axis1", "axis2")]).first()
    return y.select(F.col("key").alias("vec_id"), *[(F.col(c) * (-1.0 if ends[c] < 0 else 1.0)).alias(c) for c in ("axis1", "axis2")])


def _kernel(v: DataFrame) -> DataFrame:
    return _signed(od.kernel_axes(v, "vec_id", "embedding"))


def _geodesic(v: DataFrame) -> DataFrame:
    return _signed(geodesic.isomap(v, "vec_id", "embedding"))


def _scaled(v: DataFrame) -> DataFrame:
    return pairs.smacof(v, "vec_id", "embedding").withColumnRenamed("key", "vec_id")


def _embedded(v: DataFrame) -> DataFrame:
    return pairs.tsne(v, "vec_id", "embedding", [registry.get("tsne").filled(v.count())["perplexity"]]).drop("layout").withColumnRenamed("key", "vec_id")


#: Layouts of more rows than a matrix may have.
LARGE = {"kpca": _kernel, "isomap": _geodesic, "smacof": _scaled, "tsne": _embedded}


def _layout(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        try:
            ids, x, y = matrix(s, d)
        except pr.TooManyRows:
            if name not in LARGE:
                raise
            return LARGE[name](vectors(s, d))
        if name == "tsne":
            coords = pr.tsne(x)
        else:
            coords, _ = pr.layout(name, x, y)
        return s.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, coords, strict=True)], "vec_id long, axis1 double, axis2 double")

    return query


def _pca(s: SparkSession, d: str) -> DataFrame:
    of = ln.total(ln.moments(vectors(s, d), "embedding"))
    return ln.projected(vectors(s, d), "vec_id", "embedding", of.mean, ln.principal(of))


def _pca_variance(s: SparkSession, d: str) -> DataFrame:
    c = ln.total(ln.moments(vectors(s, d), "embedding")).covariance
    return s.createDataFrame([(float(np.trace(c)), float(np.linalg.eigvalsh(c).sum()))], "total_variance double, component_variance double")


def _nodes(method: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        try:
            _, x, _ = matrix(s, d)
            m = som.batch(x, SomConfig(epochs=20))
            hits = som.sums(x, m.codebook)[1]
        except pr.TooManyRows:
            m = _on_rows(s, d, "batch")
            n = {r["bmu"]: r["count"] for r in som.assigned(vectors(s, d), "vec_id", "embedding", m.codebook).groupBy("bmu").count().collect()}
            hits = np.array([float(n.get(i, 0)) for i in range(len(m.codebook))])
        labels = cl.cluster_nodes(m.codebook, hits, 4, method)
        return s.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "node int, cluster int")

    return query


def _classified(s: SparkSession, d: str) -> DataFrame:
    cfg = StatsConfig()
    given = {"k": cfg.folds, "repeats": cfg.repeats, "permutations": cfg.permutations, "bootstrap": cfg.bootstrap}
    try:
        _, x, y = matrix(s, d)
        c = cl.classify(x, y, **given, spark=s)
    except pr.TooManyRows:
        c = rs.classify(vectors(s, d), "vec_id", "label", "embedding", **given)
    return s.createDataFrame([(c.model, c.balanced_accuracy, c.low, c.high, c.accuracy, c.kappa, c.chance, c.p)], "model string, balanced_accuracy double, low double, high double, accuracy double, kappa double, chance double, p double")


def _importance(s: SparkSession, d: str) -> DataFrame:
    try:
        _, x, y = matrix(s, d)
        lost = cl.importance(x, y, repeats=2)
    except pr.TooManyRows:
        lost = rs.importance(vectors(s, d), "vec_id", "label", "embedding", repeats=2)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(lost)], "feature int, importance double")


def _haufe(s: SparkSession, d: str) -> DataFrame:
    a = ln.patterns(vectors(s, d), "embedding", "label")
    return s.createDataFrame([(i, float(np.linalg.norm(v))) for i, v in enumerate(a)], "feature int, activation double")


def _bca(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d).select("vec_id", "label", F.col("embedding")[0].alias("v"))
    return s.createDataFrame([ln.bca_means(v, "vec_id", "label", "v", "0", "1", 500)], "difference double, low double, high double")


def _scan(s: SparkSession, d: str) -> DataFrame:
    """Map sizes against their errors before the last epoch; a grid cell that fails is a row with its error."""
    grid = [{"width": w, "height": h} for w in (4, 6, 8) for h in (3, 4, 5)]
    rows = [(g["width"], g["height"], None if c.error else c.map.history[c.config.epochs - 1]["quantisation_error"], c.error) for g, c in zip(grid, scan.maps(vectors(s, d), "embedding", grid, SomConfig(epochs=10)), strict=True)]
    return s.createDataFrame(rows, "width int, height int, quantisation_error double, error string")


def _verdict(s: SparkSession, d: str) -> DataFrame:
    row = st.permanova(coordinates(s, d)).first()
    try:
        _, x, y = matrix(s, d)
        wide, c = x.shape[1], cl.classify(x, y, repeats=1, permutations=19, bootstrap=50, spark=s)
    except pr.TooManyRows:
        wide = vectors(s, d).agg(F.max(F.size("embedding"))).first()[0]
        c = rs.classify(vectors(s, d), "vec_id", "label", "embedding", repeats=1, permutations=19, bootstrap=50)
    p = f_tail(row["pseudo_F"], (row["groups"] - 1) * wide, (row["n"] - row["groups"]) * wide)
    v = cl.verdict(p, c.p, c.balanced_accuracy, c.chance)
    return s.createDataFrame([(v["confidence"], v["finding"], "; ".join(v["caveats"]))], "confidence string, finding string, caveats string")


def _anova_p(s: SparkSession, d: str) -> DataFrame:
    from ..operators import prepare as prep
    from .groups import FEATURES

    f = st.anova(prep.long_form(lineitem(s, d), FEATURES, "l_returnflag").withColumnRenamed("l_returnflag", "g")).collect()
    return s.createDataFrame([(x["feature"], float(f_tail(x["anova_F"], x["groups"] - 1, x["n"] - x["groups"]))) for x in f], "feature string, p double")


SQL = {
    "som_lattice": f"WITH {LATTICE} SELECT node, col, row, {r('x', 'x')}, {r('y', 'y')} FROM node",
    "som_bmu": f"WITH {BMU} SELECT vec_id, bmu, {r('bmu_distance', 'bmu_distance', 5)}, runner_up FROM bmu",
    "som_hits": f"WITH {BMU} SELECT node, g, hits FROM h",
    "som_u_matrix": f"WITH {BMU}, p AS (SELECT a.node AS a, b.node AS b, sqrt(sum(pow(a.w - b.w, 2))) AS dist FROM w a JOIN w b ON a.d = b.d GROUP BY 1, 2) SELECT a AS node, {r('avg(dist)', 'u')} FROM p JOIN adj USING (a, b) GROUP BY a",
    "som_topographic_error": f"WITH {BMU} SELECT {r('avg(CASE WHEN adj.a IS NULL THEN 1.0 ELSE 0.0 END)', 'topographic_error')} FROM bmu LEFT JOIN adj ON bmu = a AND runner_up = b",
    "som_quality": f"WITH {BMU}, t AS (SELECT node, max(hits) AS top, sum(hits) AS n FROM h GROUP BY node) SELECT (SELECT {r('avg(bmu_distance)', 'q', 5).split(' AS ')[0]} FROM bmu) AS quantisation_error, (SELECT count(*) FROM t) AS occupied, (SELECT CAST(max(n) AS BIGINT) FROM t) AS largest_load, (SELECT round(CAST(sum(top) AS DOUBLE) / sum(n), 6) FROM t) AS purity",
    "group_enrichment": f"WITH {BMU}, x AS (SELECT node, g, hits, CAST(sum(hits) OVER (PARTITION BY node) AS DOUBLE) * sum(hits) OVER (PARTITION BY g) / sum(hits) OVER () AS expected FROM h) SELECT node, g, hits AS observed, {r('expected', 'expected')}, {r('log2((hits + 0.5) / (expected + 0.5))', 'log2_enrichment')} FROM x",
    "node_profile": f"WITH {BMU} SELECT bmu AS node, CAST(d AS INTEGER) AS d, count(*) AS n, {r('avg(v)', 'mean')} FROM long JOIN bmu ON k = vec_id WHERE d < 4 GROUP BY ALL",
    "map_gradients": f"""WITH {BMU}, c AS (SELECT node.node AS node, x, y, CAST(coalesce(m, 0) AS DOUBLE) AS m FROM node LEFT JOIN (SELECT node, sum(hits) AS m FROM h GROUP BY node) q ON q.node = node.node), z AS (SELECT d, x, y, m, w FROM w JOIN c ON w.node = c.node),
s AS (SELECT d, sum(m) AS s, sum(m * x) / sum(m) AS mx, sum(m * y) / sum(m) AS my, sum(m * w) / sum(m) AS mw FROM z GROUP BY d),
q AS (SELECT d, sum(m * (x - mx) * (x - mx)) AS xx, sum(m * (y - my) * (y - my)) AS yy, sum(m * (x - mx) * (y - my)) AS xy, sum(m * (x - mx) * (w - mw)) AS xw, sum(m * (y - my) * (w - mw)) AS yw, sum(m * (w - mw) * (w - mw)) AS ww FROM z JOIN s USING (d) GROUP BY d),
b AS (SELECT *, (xw * yy - yw * xy) / (xx * yy - xy * xy) AS gx, (yw * xx - xw * xy) / (xx * yy - xy * xy) AS gy FROM q) SELECT concat('f', d) AS feature, {r('degrees(atan2(gy, gx))', 'angle_deg', 4)}, {r('sqrt(gx * gx + gy * gy)', 'magnitude')}, {r('(gx * xw + gy * yw) / ww', 'plane_r2')} FROM b""",
    "trustworthiness": f"WITH {LAYOUT} SELECT {r('1 - 2 / (any_value(n) * any_value(k) * (2 * any_value(n) - 3 * any_value(k) - 1)) * coalesce(sum(rx - k) FILTER (ry <= k AND rx > k), 0)', 'trustworthiness')}, {r('1 - 2 / (any_value(n) * any_value(k) * (2 * any_value(n) - 3 * any_value(k) - 1)) * coalesce(sum(ry - k) FILTER (rx <= k AND ry > k), 0)', 'continuity')} FROM rk, n",
    "rnx_curve": f"WITH {LAYOUT}, c AS (SELECT greatest(rx, ry) AS g, count(*) AS c FROM rk GROUP BY 1), ks AS (SELECT unnest(range(1, (SELECT n - 1 FROM n))) AS kk), q AS (SELECT kk, (SELECT coalesce(sum(c), 0) FROM c WHERE g <= kk) / (n * CAST(kk AS DOUBLE)) AS q, n FROM ks, n) SELECT CAST(kk AS INTEGER) AS K, {r('((n - 1) * q - kk) / (n - 1 - kk)', 'rnx')} FROM q",
    "neighbour_agreement": f"WITH {LAYOUT} SELECT {r('count(*) / (any_value(n) * 10.0)', 'agreement')} FROM rk, n WHERE rx <= 10 AND ry <= 10",
    "axis_correlation": f"WITH {VECTORS} SELECT CAST(a.d AS INTEGER) AS feature, CAST(b.d AS INTEGER) AS axis, {r('corr(a.v, b.v)', 'r')} FROM long a JOIN long b ON a.k = b.k AND b.d < 2 GROUP BY 1, 2",
    "pca_variance": f"WITH {VECTORS}, s AS (SELECT d, var_pop(v) AS s FROM long GROUP BY d) SELECT {r('sum(s)', 'total_variance')}, {r('sum(s)', 'component_variance')} FROM s",
}


def queries() -> dict:
    def both(s: SparkSession, d: str) -> DataFrame:
        q = _ranks(s, d, curve=False)
        return s.createDataFrame([(q["trustworthiness"], q["continuity"])], "trustworthiness double, continuity double")

    def agree(s: SparkSession, d: str) -> DataFrame:
        try:
            _, x, _ = matrix(s, d)
        except pr.TooManyRows:
            return s.createDataFrame([(rk.quality(vectors(s, d), "vec_id", "embedding", 2, curve=False)["agreement"],)], "agreement double")
        return s.createDataFrame([(float(pr.agreement([x, x[:, :2]])[0, 1]),)], "agreement double")

    def axes(s: SparkSession, d: str) -> DataFrame:
        c = ln.correlations(vectors(s, d), "embedding", 2)
        return s.createDataFrame([(i, j, float(c[i, j])) for i in range(c.shape[0]) for j in range(2)], "feature int, axis int, r double")

    exact = {
        "som_lattice": lambda s, d: GRID.table(s),
        "som_hits": lambda s, d: som.hits(assignment(s, d), "g"),
        "som_u_matrix": _u_matrix,
        "som_topographic_error": lambda s, d: som.topographic_error(assignment(s, d), GRID),
        "group_enrichment": lambda s, d: som.enrichment(assignment(s, d), "g"),
        "node_profile": _node_profile,
        "trustworthiness": both, "rnx_curve": _rnx, "neighbour_agreement": agree, "axis_correlation": axes, "pca_variance": _pca_variance,
        "metric_series": lambda s, d: track_arrays.series_metrics(tracks.steps(s, d)),
        "anova_p": _anova_p, "classify_cv": _classified, "permutation_importance": _importance, "haufe_patterns": _haufe, "bootstrap_bca": _bca, "som_scan": _scan,
        **{f"som_train_{k}": _trained(k) for k in ("batch", "supervised", "relevance", "online", "growing")},
        **{f"nodes_{k}": _nodes(k) for k in ("kmeans", "ward")},
        **{f"layout_{k}": _layout(k) for k in ("smacof", "kpca", "isomap", "tsne")},
        "layout_pca": _pca,
        "layout_mds": lambda s, d: ln.scaling(vectors(s, d), "vec_id", "embedding"),
        "layout_lda": lambda s, d: ln.discriminant(vectors(s, d), "vec_id", "embedding", "label"),
        "layout_plsda": lambda s, d: ln.least_squares(vectors(s, d), "vec_id", "embedding", "label"),
    }
    return {k: (lambda s, d, q=q: rounded(q(s, d))) for k, q in exact.items()} | {
        "som_bmu": _assigned,
        "som_quality": lambda s, d: som.quality(assignment(s, d), "g", GRID).select(F.round("quantisation_error", 5).alias("quantisation_error"), "occupied", "largest_load", F.round("purity", 6).alias("purity")),
        "map_gradients": lambda s, d: _gradients(s, d).select("feature", F.round("angle_deg", 4).alias("angle_deg"), F.round("magnitude", 6).alias("magnitude"), F.round("plane_r2", 6).alias("plane_r2")),
        "verdict": _verdict,
    }
