"""Queries of cross-validation: embeddings by label, and lineitem's return flags with line numbers as replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crossval as cv
from ..operators import forest as fo
from .groups import FEATURES, vectors
from .tracks import rounded

SQL = {
    "fold_plan_stratified": "SELECT vec_id AS key, CAST(repeat AS INTEGER) AS repeat, CAST((row_number() OVER (PARTITION BY repeat, label ORDER BY md5(concat('0|', repeat, '|', vec_id)), vec_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT *, unnest(range(5)) AS repeat FROM embeddings)",
}


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), "l_returnflag", "l_linenumber", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("v"))


def queries() -> dict:
    return {
        "fold_plan_stratified": lambda s, d: cv.fold_plan(vectors(s, d), "vec_id", "label")[0].select("key", F.posexplode("folds").alias("repeat", "fold")),
        "cv_recall": lambda s, d: rounded(cv.recall_table(vectors(s, d), "vec_id", "label", "embedding")),
        "cv_pairwise": lambda s, d: rounded(cv.pairwise_accuracy(vectors(s, d), "vec_id", "label", "embedding")),
        "cv_recall_replicates": lambda s, d: rounded(cv.recall_table(flags(s, d), "row", "l_returnflag", "v", "l_linenumber", "leave_one_replicate_out")),
        "cv_pairwise_replicates": lambda s, d: rounded(cv.pairwise_accuracy(flags(s, d), "row", "l_returnflag", "v", "l_linenumber")),
        "forest_importance": lambda s, d: rounded(fo.importance(vectors(s, d), "vec_id", "label", "embedding", [f"e{i:02d}" for i in range(64)])),
    }
