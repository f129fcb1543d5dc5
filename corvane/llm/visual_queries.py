"""Queries p7_*."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.visual_forms import form_sql, visual_classes, visual_pairs
from corvane.sources.tables import table


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """(field, owner, id, value); only aliases are compared within an owner."""
    names = table(spark, folder, "person_aliases", "id", "person_id", "name")
    titles = table(spark, folder, "works", "id", "title_original")
    codes = table(spark, folder, "releases", "id", "code")
    parts = [
        names.select(F.lit("person_aliases.name").alias("field"), F.col("person_id").alias("owner"), "id", F.col("name").alias("value")),
        titles.select(F.lit("works.title_original").alias("field"), F.lit("").alias("owner"), "id", F.col("title_original").alias("value")),
        codes.select(F.lit("releases.code").alias("field"), F.lit("").alias("owner"), "id", F.col("code").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows whose values differ but look the same."""
    return visual_pairs(_values(spark, folder), ["field", "owner"], "id", "value").select("field", "id_a", "id_b")


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of each value."""
    return visual_classes(_values(spark, folder).distinct(), ["field", "owner"], "value").select("field", "id", "value", "form")


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}
_READABLE, _KEY = form_sql("value")
_ROWS = f"""WITH v AS (SELECT DISTINCT 'person_aliases.name' AS field, person_id AS owner, id, name AS value FROM person_aliases UNION ALL SELECT DISTINCT 'works.title_original', '', id, title_original FROM works UNION ALL SELECT DISTINCT 'releases.code', '', id, code FROM releases),
f AS (SELECT *, {_READABLE} AS plain FROM v), k AS (SELECT *, {_KEY} AS class FROM f),
n AS (SELECT field, owner, class, plain, value, count(*) AS n FROM k WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT field, owner, class, plain AS form FROM n QUALIFY row_number() OVER (PARTITION BY field, owner, class ORDER BY n DESC, length(plain), plain) = 1)
"""
SQL = {
    "p7_found": _ROWS + "SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field = b.field AND a.owner IS NOT DISTINCT FROM b.owner AND a.class = b.class AND a.value <> b.value AND a.id < b.id",
    "p7_forms": _ROWS + "SELECT k.field, id, value, form FROM k LEFT JOIN c ON c.field = k.field AND c.owner IS NOT DISTINCT FROM k.owner AND c.class = k.class",
}
