"""Schemas of the catalog's tables, and checks of what a relational store would enforce."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_AUDIT = "created_at timestamp, updated_at timestamp"
_DDL = {
    "people": f"id string, slug string, primary_name string, name_ja string, name_zh string, name_en string, biography string, birth_date date, birth_date_precision string, birthplace string, height_cm int, measurements struct<bust:int, waist:int, hip:int, cup:string>, interests array<string>, active boolean, status string, confidence string, {_AUDIT}",
    "person_aliases": f"id string, person_id string, name string, language string, valid_from date, valid_to date, is_primary boolean, {_AUDIT}",
    "career_events": f"id string, person_id string, type string, event_date date, date_precision string, note string, {_AUDIT}",
    "organizations": f"id string, slug string, type string, name string, name_ja string, name_zh string, {_AUDIT}",
    "affiliations": f"id string, person_id string, organization_id string, role string, valid_from date, valid_to date, {_AUDIT}",
    "works": f"id string, slug string, title_original string, title_zh string, title_en string, synopsis string, status string, confidence string, {_AUDIT}",
    "releases": f"id string, work_id string, code string, release_date date, runtime_minutes int, medium string, distributor_id string, {_AUDIT}",
    "credits": f"work_id string, person_id string, credited_as string, credit_type string, billing_order int, {_AUDIT}",
    "tags": f"id string, slug string, display_name string, original_name string, parent_id string, deprecated_by_id string, {_AUDIT}",
    "work_tags": "work_id string, tag_id string",
    "sources": f"id string, name string, role string, base_url string, terms_url string, {_AUDIT}",
    "observations": f"id string, source_id string, entity_type string, entity_id string, source_url string, field_path string, observed_value string, content_hash string, observed_at timestamp, {_AUDIT}",
    "resolutions": f"id string, entity_type string, entity_id string, field_path string, chosen_observation_id string, status string, note string, {_AUDIT}",
    "media_assets": f"id string, entity_type string, entity_id string, kind string, uri string, rights string, hidden boolean, {_AUDIT}",
    "reports": f"id string, entity_type string, entity_id string, category string, detail string, status string, {_AUDIT}",
    "audit_log": "id string, actor string, action string, entity_type string, entity_id string, detail string, created_at timestamp",
}
TABLES = tuple(_DDL)


@cache
def schema(table: str) -> StructType:
    """The schema of a table. Needs a running session."""
    return StructType.fromDDL(_DDL[table])


# The domains of enumerated columns, in their declared order.
ENUMS = {
    "publication_status": ["draft", "review", "published", "hidden"],
    "confidence_level": ["unverified", "low", "medium", "high", "confirmed"],
    "career_event_type": ["debut", "retirement", "comeback", "hiatus", "other"],
    "organization_type": ["agency", "maker", "label", "studio", "distributor"],
    "source_role": ["authoritative", "reference", "community", "manual"],
    "resolution_status": ["pending", "accepted", "rejected"],
    "media_kind": ["portrait", "cover", "still"],
    "rights_status": ["unknown", "link_only", "licensed", "removed"],
}


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row bears, with the number of rows. Keys with a NULL part aren't compared."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.where(known).groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `child` whose key, if set, names no row of `parent`."""
    named = parent.select(F.col(key).alias("_known")).distinct()
    return child.where(F.col(foreign_key).isNotNull()).join(named, F.col(foreign_key) == F.col("_known"), "left_anti")


def outside_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows whose value, if set, isn't in the domain."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain))
