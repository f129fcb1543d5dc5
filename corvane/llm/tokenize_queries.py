"""Queries p8_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.tokenize import encode_corpus
from corvane.sources.tables import table

#: Where the vocabulary file lies on the driver.
VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document."""
    return encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", VOCABULARY_FILE)


def p8_source_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens of each source."""
    docs = table(spark, folder, "documents", "source", "text")
    counted = encode_corpus(docs, "source", "text", VOCABULARY_FILE)
    return counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_source_tokens": p8_source_tokens}
SQL: dict[str, str] = {}
