"""Queries over all pairs of the vectors of embeddings: principal coordinates, dispersions, nulls, Shepard correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordination as od
from .groups import vectors
from .tracks import r, rounded

#: Squared cosine distances within groups; a row's distance to its group's centroid follows from their sums.
COSINE = """v AS (SELECT vec_id AS key, CAST(label AS VARCHAR) AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.key AS key, a.g AS g, pow(CASE WHEN a.key = b.key THEN 0 ELSE 1 - list_cosine_similarity(a.e, b.e) END, 2) AS q FROM v a JOIN v b ON a.g = b.g),
s AS (SELECT key, g, sum(q) AS s FROM d GROUP BY key, g), w AS (SELECT g, sum(s) AS t, count(*) AS n FROM s GROUP BY g),
z AS (SELECT key, s.g AS g, sqrt(greatest(s / n - t / (2.0 * n * n), 0)) AS dist FROM s JOIN w ON s.g = w.g)"""

SHEPARD = """v AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT list_distance(a.e, b.e) AS x, list_distance(a.e[1:2], b.e[1:2]) AS y FROM v a JOIN v b ON a.k < b.k),
q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM p)"""

SQL = {
    "permdisp_cosine_distances": f"WITH {COSINE} SELECT key, g, {r('dist', 'dist')} FROM z",
    "shepard_coordinates": f"WITH {SHEPARD} SELECT count(*) AS pairs, round(corr(x, y), 4) AS spearman FROM q",
}


def pcoa_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with their first two principal coordinates of cosine distances."""
    v = vectors(spark, sf_dir)
    axes = od.pcoa(v, "vec_id", "embedding", "cosine", axes=2).where(~F.col("imaginary"))
    layout = axes.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "coordinate"))), lambda x: x["coordinate"]).alias("layout"))
    return v.join(layout, F.col("vec_id") == F.col("key"))


def queries() -> dict:
    return {
        "pcoa_cosine": lambda s, d: rounded(od.pcoa(vectors(s, d), "vec_id", "embedding", "cosine")),
        "permdisp_cosine_distances": lambda s, d: rounded(od.dispersions(vectors(s, d), "vec_id", "label", "embedding", "cosine")),
        "permdisp_cosine_p": lambda s, d: rounded(od.permdisp(vectors(s, d), "vec_id", "label", "embedding", "cosine")),
        "permanova_null_999": lambda s, d: rounded(od.permuted_F(vectors(s, d), "vec_id", "label", "embedding", 999)),
        "shepard_coordinates": lambda s, d: od.shepard(vectors(s, d).withColumn("layout", F.slice("embedding", 1, 2)), "vec_id", "embedding", "layout").select("pairs", F.round("spearman", 4).alias("spearman")),
        "shepard_pcoa": lambda s, d: od.shepard(pcoa_layout(s, d), "vec_id", "embedding", "layout"),
    }
