"""Spark session and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int = 8, app: str = "corvane", memory: str = "20g", checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings that the engine relies on: UTC, AQE, Arrow. Checkpoints that nothing refers to any more are deleted."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return (builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else builder).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that a lost executor costs no recomputation from the start.

    The folder is the session's `spark.checkpoint.dir`, which all executors share. A session that runs on one machine only (`local[...]`) may
    leave it unset and gets a temporary folder; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is computed within, checkpoints above all, are deleted as soon as each action ends.

    Otherwise they stay until the driver happens to collect its garbage, so that disk holds the shuffles of all steps at once. What is read
    again is computed again from the checkpoints.
    """
    before = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREES)
        else:
            spark.conf.set(_FREES, before)
