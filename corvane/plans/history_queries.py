"""Queries p1_* and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.history import OPEN_END, attribute_versions, entity_versions
from corvane.sources.tables import table

_ARRIVAL, _ATTRIBUTES = ("received_at", "snapshot_id"), ("active", "stage_name")


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "people_snapshots", "person_id", "snapshot_date", *_ARRIVAL, *_ATTRIBUTES)


def _dates(df: DataFrame, *keep: str) -> DataFrame:
    to = F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit(OPEN_END))
    return df.select(*keep, F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), to.alias("valid_to"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The periods of all versions of each delivered person."""
    return _dates(entity_versions(_deliveries(spark, folder), "person_id", "snapshot_date", _ARRIVAL, _ATTRIBUTES), "person_id")


def p1_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The same with what held in each period."""
    return _dates(entity_versions(_deliveries(spark, folder), "person_id", "snapshot_date", _ARRIVAL, _ATTRIBUTES), "person_id", "active", "stage_name")


def p1_attribute_log(spark: SparkSession, folder: str) -> DataFrame:
    """The periods of each attribute by itself."""
    return _dates(attribute_versions(_deliveries(spark, folder), "person_id", "snapshot_date", _ARRIVAL, _ATTRIBUTES), "person_id", "attribute", "value")


def p1_stale_state(spark: SparkSession, folder: str) -> DataFrame:
    """People rows whose `active` differs from the version that holds now."""
    now = entity_versions(_deliveries(spark, folder), "person_id", "snapshot_date", _ARRIVAL, _ATTRIBUTES).where("valid_to is null")
    told = now.select("person_id", F.col("active").alias("delivered"), F.col("valid_from").cast("string").alias("since"))
    rows = table(spark, folder, "people", "id", "active").distinct()
    return rows.join(told, rows["id"] == told["person_id"]).where(~F.col("active").eqNullSafe(F.col("delivered"))).select("person_id", "active", "delivered", "since")


_LATEST = """WITH d AS (SELECT DISTINCT * FROM people_snapshots WHERE person_id IS NOT NULL AND snapshot_date IS NOT NULL),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY person_id, snapshot_date
  ORDER BY received_at DESC NULLS LAST, snapshot_id DESC NULLS LAST, active DESC NULLS LAST, stage_name DESC NULLS LAST) = 1),
f AS (SELECT *, row_number() OVER w = 1 OR active IS DISTINCT FROM lag(active) OVER w OR stage_name IS DISTINCT FROM lag(stage_name) OVER w AS starts
  FROM l WINDOW w AS (PARTITION BY person_id ORDER BY snapshot_date)),
v AS (SELECT person_id, active, stage_name, strftime(snapshot_date, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(lead(snapshot_date) OVER (PARTITION BY person_id ORDER BY snapshot_date), '%Y-%m-%d'), '9999-12-31') AS valid_to FROM f WHERE starts)
"""

QUERIES = {"p1_found": p1_found, "p1_versions": p1_versions, "p1_attribute_log": p1_attribute_log, "p1_stale_state": p1_stale_state}
SQL = {
    "p1_found": _LATEST + "SELECT person_id, valid_from, valid_to FROM v",
    "p1_versions": _LATEST + "SELECT person_id, active, stage_name, valid_from, valid_to FROM v",
    "p1_attribute_log": _LATEST
    + """, u AS (SELECT person_id, snapshot_date, 'active' AS attribute, CAST(active AS VARCHAR) AS value FROM l
  UNION ALL SELECT person_id, snapshot_date, 'stage_name', stage_name FROM l),
c AS (SELECT *, row_number() OVER w = 1 OR value IS DISTINCT FROM lag(value) OVER w AS starts FROM u WINDOW w AS (PARTITION BY person_id, attribute ORDER BY snapshot_date))
SELECT person_id, attribute, value, strftime(snapshot_date, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(lead(snapshot_date) OVER (PARTITION BY person_id, attribute ORDER BY snapshot_date), '%Y-%m-%d'), '9999-12-31') AS valid_to FROM c WHERE starts""",
    "p1_stale_state": _LATEST
    + """SELECT v.person_id, p.active, v.active AS delivered, v.valid_from AS since FROM v
JOIN (SELECT DISTINCT id, active FROM people) p ON p.id = v.person_id WHERE v.valid_to = '9999-12-31' AND p.active IS DISTINCT FROM v.active""",
}
