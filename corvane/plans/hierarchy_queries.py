"""Queries p5_* and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.hierarchy import clean_links, descendants, materialise_paths, resolve_forest
from corvane.session import cut_lineage
from corvane.sources.tables import table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    tags = table(spark, folder, "tags", "id", "parent_id", "deprecated_by_id")
    return cut_lineage(clean_links(tags.withColumn("up", F.coalesce("deprecated_by_id", "parent_id")), "id", "up"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of each tag; -1 and the circle's smallest id where it runs in a circle."""
    return resolve_forest(_links(spark, folder)).select(F.col("id").alias("tag_id"), F.col("root").alias("root_id"), "depth")


def p5_circles(spark: SparkSession, folder: str) -> DataFrame:
    """Each circle by its smallest id, with the number of tags on it or leading into it."""
    return resolve_forest(_links(spark, folder)).where("circular").groupBy(F.col("root").alias("circle_id")).agg(F.count("*").alias("tags"))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    links = _links(spark, folder)
    return materialise_paths(links, resolve_forest(links))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The full path from the root to each tag."""
    return _paths(spark, folder).select(F.col("id").alias("tag_id"), F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every tag under each tag, with its distance."""
    return descendants(_paths(spark, folder)).select(F.col("ancestor").alias("tag_id"), F.col("id").alias("descendant_id"), "distance")


_LINKS = """WITH RECURSIVE n AS (SELECT lower(id) AS id, min(lower(coalesce(deprecated_by_id, parent_id))) AS up FROM tags WHERE id IS NOT NULL GROUP BY 1),
l AS (SELECT n.id, k.id AS up FROM n LEFT JOIN n k ON n.up = k.id),
"""
_TREE = _LINKS + """t AS (SELECT id, id AS root, 0 AS depth, id AS path FROM l WHERE up IS NULL
  UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || '/' || l.id FROM l JOIN t ON l.up = t.id),
"""
_CIRCLES = """w AS (SELECT id AS start, id AS cur FROM l WHERE id NOT IN (SELECT id FROM t) UNION SELECT w.start, l.up FROM w JOIN l ON l.id = w.cur),
mem AS (SELECT DISTINCT w.start AS id FROM w JOIN l ON l.id = w.cur WHERE l.up = w.start),
c AS (SELECT w.start AS id, min(w.cur) AS root FROM w WHERE w.cur IN (SELECT id FROM mem) GROUP BY 1)
"""

QUERIES = {"p5_found": p5_found, "p5_circles": p5_circles, "p5_paths": p5_paths, "p5_descendants": p5_descendants}
SQL = {
    "p5_found": _TREE + _CIRCLES + "SELECT id AS tag_id, root AS root_id, depth FROM t UNION ALL SELECT id, root, -1 FROM c",
    "p5_circles": _TREE + _CIRCLES + "SELECT root AS circle_id, count(*) AS tags FROM c GROUP BY 1",
    "p5_paths": _TREE.rstrip().rstrip(",") + " SELECT id AS tag_id, path FROM t",
    "p5_descendants": _TREE + "d AS (SELECT up AS tag_id, id AS descendant_id, 1 AS distance FROM l WHERE up IN (SELECT id FROM t) UNION ALL SELECT l.up, d.descendant_id, d.distance + 1 FROM d JOIN l ON l.id = d.tag_id WHERE l.up IS NOT NULL) SELECT * FROM d",
}
