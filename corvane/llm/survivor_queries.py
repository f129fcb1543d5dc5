"""Queries p4_* and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.survivor import Field, best_representative, recency
from corvane.sources.tables import table

# The orders of the catalog, best first.
_CONFIDENCE = ["confirmed", "high", "medium", "low", "unverified"]
_ROLE = ["authoritative", "reference", "community", "manual"]
_PRECISION = ["day", "month", "year"]
_HALF_LIFE_DAYS = 1_460.0
_NAMES = ["primary_name", "name_ja", "name_zh", "name_en", "biography", "birthplace", "active", "status"]


def _level(value: Column, best_first: list[str]) -> Column:
    """How good a value is: the length of the list for the best, 0 for one that isn't listed or NULL."""
    word = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in reversed(best_first)]), word).cast("int"), F.lit(0))


def slug_form(slug: Column) -> Column:
    """Trimmed, lower case, words joined by '-'."""
    return F.regexp_replace(F.lower(F.regexp_replace(slug, r"(?U)^[\s_-]+|[\s_-]+$", "")), r"(?U)[\s_-]+", "-")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """People rows of slugs that several ids bear, with the levels of confidence, role and precision."""
    people = table(spark, folder, "people").distinct().withColumn("slug", slug_form(F.col("slug")))
    shared = people.where("slug is not null and id is not null").groupBy("slug").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo <> _hi").select("slug")
    rows = people.join(shared, "slug", "left_semi")
    seen = table(spark, folder, "observations", "entity_id", "source_id").where("entity_id is not null").distinct()
    roles = table(spark, folder, "sources", "id", "role").select(F.col("id").alias("source_id"), _level(F.col("role"), _ROLE).alias("role"))
    best = seen.join(roles, "source_id").groupBy("entity_id").agg(F.max("role").alias("role"))
    joined = rows.join(best, rows["id"] == best["entity_id"], "left")
    return joined.select(*[rows[c] for c in people.columns], _level(rows["confidence"], _CONFIDENCE).alias("_confidence"), F.coalesce(best["role"], F.lit(0)).alias("_role"), _level(rows["birth_date_precision"], _PRECISION).alias("_precision"))


def _survivors(spark: SparkSession, folder: str, fields: dict[str, Field]) -> DataFrame:
    rank = (F.col("_confidence") * 5 + F.col("_role")) * 4 + F.col("_precision")
    ranked = _candidates(spark, folder).withColumn("_rank", rank)
    best = Window.partitionBy("slug", "id").orderBy(F.col("_rank").desc(), F.col("updated_at").desc_nulls_last())
    rows = ranked.withColumn("_first", F.row_number().over(best) == 1)
    as_of = table(spark, folder, "people", "updated_at").agg(F.max("updated_at")).first()[0]
    decay = recency(F.col("updated_at"), F.lit(as_of), _HALF_LIFE_DAYS)
    return best_representative(rows, "slug", fields, decay, F.col("updated_at"))


def _identity() -> Field:
    """The surviving id: each step of confidence outweighs all roles, each role all precisions; decay (over a half to 1) decides among equals.

    Of differing rows of one id only the best votes, as several votes could add up to a step.
    """
    return Field(F.when(F.col("_first"), F.col("id")), F.pow(F.lit(4.0), F.col("_rank")))


def _content() -> dict[str, Field]:
    trust = (F.col("_confidence") + 1) * (F.col("_role") + 1) / 30.0
    text = {c: Field(F.col(c), trust, F.lower(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", " "))) for c in _NAMES}
    dated = trust * F.pow(F.lit(4.0), F.col("_precision"))
    known = F.lower(F.trim("birth_date_precision"))
    return text | {"birth_date": Field(F.col("birth_date"), dated), "birth_date_precision": Field(F.when(F.col("birth_date").isNotNull(), known), dated)}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving id of each slug that several ids bear."""
    return _survivors(spark, folder, {"person_id": _identity()})


def p4_record(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each such slug: the best id and the best value of every field."""
    return _survivors(spark, folder, {"person_id": _identity()} | _content())


_ROWS = r"""WITH p AS (SELECT DISTINCT * REPLACE (regexp_replace(lower(regexp_replace(slug, '^[\s_-]+|[\s_-]+$', '', 'g')), '[\s_-]+', '-', 'g') AS slug) FROM people),
r AS (SELECT o.entity_id, max(CASE role WHEN 'authoritative' THEN 4 WHEN 'reference' THEN 3 WHEN 'community' THEN 2 WHEN 'manual' THEN 1 ELSE 0 END) AS role
  FROM observations o JOIN sources s ON s.id = o.source_id GROUP BY 1),
c AS (SELECT p.*, CASE lower(trim(confidence)) WHEN 'confirmed' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END AS conf,
  coalesce(r.role, 0) AS role, CASE lower(trim(birth_date_precision)) WHEN 'day' THEN 3 WHEN 'month' THEN 2 WHEN 'year' THEN 1 ELSE 0 END AS prec
  FROM p LEFT JOIN r ON r.entity_id = p.id WHERE slug IN (SELECT slug FROM p GROUP BY slug HAVING count(DISTINCT id) > 1))
"""
_FIELDS = {**{c: (f"CAST({c} AS VARCHAR)", f"lower(regexp_replace(CAST({c} AS VARCHAR), '\\s+', ' ', 'g'))", "1") for c in _NAMES}, "birth_date": ("CAST(birth_date AS VARCHAR)", "CAST(birth_date AS VARCHAR)", "pow(4, prec)"), "birth_date_precision": (*["CASE WHEN birth_date IS NOT NULL THEN lower(trim(birth_date_precision)) END"] * 2, "pow(4, prec)")}
_UNPIVOT = " UNION ALL ".join(f"SELECT slug, '{c}' AS field, {value} AS value, {normal} AS normal, (conf + 1) * (role + 1) / 30.0 * {more} * decay AS vote, updated_at FROM d" for c, (value, normal, more) in _FIELDS.items())
_WINNER = "SELECT slug, id AS person_id FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY conf DESC, role DESC, prec DESC, updated_at DESC NULLS LAST, id DESC) = 1"
QUERIES = {"p4_found": p4_found, "p4_record": p4_record}
SQL = {
    "p4_found": _ROWS + _WINNER,
    "p4_record": _ROWS
    + f""", d AS (SELECT c.*, coalesce(0.5 + 0.5 * pow(0.5, greatest((epoch_us((SELECT max(updated_at) FROM people)) - epoch_us(updated_at)) / (86400e6 * {_HALF_LIFE_DAYS}), 0)), 0.5) AS decay FROM c),
u AS ({_UNPIVOT}), g AS (SELECT slug, field, normal, sum(vote) AS vote, max(updated_at) AS newest, arg_max(value, (updated_at, value)) AS value FROM u WHERE normal IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY slug, field ORDER BY round(log2(vote), 9) DESC, newest DESC NULLS LAST, value DESC) = 1),
w AS ({_WINNER})
SELECT w.slug, w.person_id, """
    + ", ".join(f"max(CASE WHEN field = '{c}' THEN value END) AS {c}" for c in _FIELDS)
    + " FROM w LEFT JOIN e ON e.slug = w.slug GROUP BY 1, 2",
}
