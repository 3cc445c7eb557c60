"""From documents to packed sequences: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of docs; a stage that changes a text also sets n_chars where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import packing, pii_crf, quality_cascade, simhash, suffix_dedup
from trackloom.llm.common import configured, free_name, stored, with_key, with_text


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects, unchanged; a null text has no words and goes."""
    configured(spark)
    return quality_cascade.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id; of rows of one id, the first by text."""
    configured(spark)
    rows, key = with_key(docs)
    found = simhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that occur earlier; a text may become empty, and a null one stays null."""
    configured(spark)
    rows, key = with_key(docs)
    kept = free_name(rows.columns, "kept_text")
    null = free_name([*rows.columns, kept], "null_text")
    found = suffix_dedup.texts(rows.select(F.col(key).alias("doc_id"), "text")).toDF(key, kept)
    others = rows.withColumn(null, F.col("text").isNull()).drop("text")  # the old texts stay where they are
    return with_text(others.join(found, key), F.when(~F.col(null), F.col(kept))).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data replaced by its kind; a null text stays null, an empty one empty, and rows
    that repeat stay."""
    configured(spark)
    return with_text(pii_crf.redacted(docs), F.col("text")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of every piece of the documents in sequences; a null or empty text is its end id, and each row
    of a repeated id has pieces of its own."""
    configured(spark)
    return packing.digests(packing.packed(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("personal_data", personal_data), ("packed", packed)]

#: SQL cannot express the field of the fourth stage or the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents; each stage's result is stored and read again."""
    docs = configured(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
