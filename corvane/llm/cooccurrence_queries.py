"""Queries p6_* and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.cooccurrence import items_together
from corvane.sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return items_together(table(spark, folder, "credits", "work_id", "person_id"), "work_id", "person_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of persons that share many more works than chance lets expect."""
    return _pairs(spark, folder).select(F.col("item_a").alias("person_id_a"), F.col("item_b").alias("person_id_b"))


def p6_association(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts and the corrected odds ratio."""
    return _pairs(spark, folder).select(F.col("item_a").alias("person_id_a"), F.col("item_b").alias("person_id_b"), "n_ab", "n_a", "n_b", F.round("odds_ratio", 4).alias("odds_ratio"))


_PAIRS = """WITH c AS (SELECT DISTINCT work_id, person_id FROM credits WHERE work_id IS NOT NULL AND person_id IS NOT NULL),
n AS (SELECT count(DISTINCT work_id) AS n FROM credits), m AS (SELECT person_id, count(*) AS k FROM c GROUP BY 1),
p AS (SELECT a.person_id AS person_id_a, b.person_id AS person_id_b, count(*) AS n_ab FROM c a JOIN c b ON a.work_id = b.work_id AND a.person_id < b.person_id GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT p.*, x.k AS n_a, y.k AS n_b, n.n FROM p JOIN m x ON x.person_id = person_id_a JOIN m y ON y.person_id = person_id_b, n WHERE n_ab * n.n >= 10 * x.k * y.k)
"""
QUERIES = {"p6_found": p6_found, "p6_association": p6_association}
SQL = {
    "p6_found": _PAIRS + "SELECT person_id_a, person_id_b FROM r",
    "p6_association": _PAIRS + "SELECT person_id_a, person_id_b, n_ab, n_a, n_b, round((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 4) AS odds_ratio FROM r",
}
