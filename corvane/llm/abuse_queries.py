"""Queries p10_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.abuse import score_documents
from corvane.sources.tables import table


def _scored(spark: SparkSession, folder: str, *carried: str) -> DataFrame:
    labels = table(spark, folder, "content_labels", "doc_id", "abusive")
    return score_documents(table(spark, folder, "documents", "doc_id", "text", *carried), "doc_id", "text", labels, "doc_id", "abusive", carried)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document whose own words are abusive, hateful or sexually explicit."""
    return _scored(spark, folder).where("abusive").select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of each document."""
    return _scored(spark, folder).select("doc_id", F.round("score", 4).alias("score"), F.round("p_value", 6).alias("p_value"), "passages", "abusive")


def p10_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source the documents and the share that is abusive."""
    return _scored(spark, folder, "source").groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("share"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}
SQL: dict[str, str] = {}
