"""Queries p9_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.leaks import leaked_passages
from corvane.sources.tables import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that holds a passage of a test item, with the item."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and its longest passage."""
    return _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.max("span").alias("longest_passage"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
