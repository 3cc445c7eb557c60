"""Queries of neighbour graphs of embeddings and of the layout made of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours as nb
from ..operators import umap as um
from .groups import vectors
from .tracks import rounded

K = 15

SQL = {
    "neighbours_exact": f"""WITH v AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.k AS node, b.k AS other, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.k % 20 = 0 AND a.k <> b.k)
SELECT node, CAST(place AS INTEGER) AS place, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, other) AS place FROM p) WHERE place <= {K}""",
}


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.exact_neighbours(vectors(spark, sf_dir), "vec_id", "embedding", K, F.col("vec_id") % 20 == 0)


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest of every query are, in order."""
    each = exact(spark, sf_dir).groupBy("node").agg(F.sort_array(F.collect_list("d")).alias("d"))
    return each.select("node", F.posexplode("d").alias("place", "d")).select("node", (F.col("place") + 1).alias("place"), F.round("d", 6).alias("d"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.neighbour_graph(vectors(spark, sf_dir), "vec_id", "embedding", K)


def queries() -> dict:
    return {
        "neighbours_exact": _exact,
        "neighbour_graph": lambda s, d: rounded(graph(s, d)),
        "neighbour_recall": lambda s, d: rounded(nb.recall(graph(s, d), exact(s, d))),
        "layout_umap": lambda s, d: um.umap(vectors(s, d), "vec_id", "embedding", K),
    }
