"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "v", "u").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(`entity`, `group`): each end of a link with the smallest entity of its component.

    links: (`a`, `b`). Alternates between joining every node's larger and smaller neighbours to its
    smallest one, until nothing changes. Each step is a grouping by node with a minimum, so a hot node
    is pre-aggregated; after a few steps every component is a star around its smallest node, also one
    that began as a long chain. No links: no rows.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    now = _mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = cut_lineage(small)
        before, now = now, _mark(small)
        edges = small
        if now == before:
            break
    return edges.select(F.col("u").alias("entity"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("entity"), F.col("v").alias("group"))).distinct()
