"""Observations as a stream of files; beyond what the catalog itself does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.schema import schema


def observation_stream(spark: SparkSession, folder: str, late: str = "30 days", files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of observations, repeats of one id and content within `late` of the newest row dropped.

    The watermark bounds the state, so rows that come later than that are left out.
    """
    rows = spark.readStream.schema(schema("observations")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["id", "content_hash"])
