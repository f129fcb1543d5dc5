"""Positions in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage


def with_position(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """`df` with `name`, the 0-based position of each row in the order, which should be total.

    Rows are partitioned by range of the order and sorted there; of each partition only its size comes to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(part).agg(F.count("*")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    # one row per partition
    at = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    return marked.join(F.broadcast(at), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_start")
