"""Queries p3_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.filters import text_filter
from corvane.llm.linkage import all_forms, attribute_edges, link, pages, same_places, stated_forms, weigh
from corvane.llm.variant_queries import people_entities, people_names, people_rows
from corvane.llm.variants import character_forms, form_hashes, place_key, typed_names, with_rates, with_readings
from corvane.session import cut_lineage, freed_shuffles
from corvane.sources.tables import table


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    """(`page`, `person_id`, `confidence`)."""
    with freed_shuffles(spark):
        return _links(spark, folder)


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(people_rows(spark, folder))
    forms = character_forms(rows, "name_ja", "name_zh")
    names, dictionary = people_names(rows, spark, folder, forms, with_aliases=False)
    entities, places = people_entities(rows, forms)
    known = with_rates(cut_lineage(entities))
    stated = cut_lineage(pages(table(spark, folder, "observations", "entity_type", "entity_id", "source_url", "field_path", "observed_value")))
    typed = with_readings(typed_names(stated.where("field = 'name'"), "page", "value", forms).distinct(), dictionary)
    dates = stated.where("field = 'date'").groupBy("page").agg(F.max(F.struct("level", "date")).alias("d")).select("page", "d.date", "d.level")
    at = stated.where("field = 'place'").select("page", place_key(F.col("value"), forms).alias("place")).join(places, "place", "left")
    at = at.groupBy("page").agg(F.max(F.coalesce("same", "place")).alias("place"))
    facts = stated.select("page").distinct().join(dates, "page", "left").join(at, "page", "left")
    asked = cut_lineage(stated_forms(typed, facts))
    offered = all_forms(names, "entity", False, text_filter(asked.select("form"), form_hashes))
    edges = cut_lineage(attribute_edges(asked, offered, known))
    # of an entity's rows the one that states most stands for it
    said = sum((F.col(c).isNotNull().cast("int") for c in ("name_ja", "name_zh", "name_en", "birth_date", "birthplace")), F.lit(0))
    row = rows.groupBy("entity").agg(F.max(F.struct("level", said.alias("said"), "id")).alias("r")).select("entity", F.col("r.id").alias("person_id"))
    return link(weigh(edges, cut_lineage(same_places(edges)))).join(row, "entity").select("page", "person_id", "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The people row that each page that isn't linked describes."""
    return _linked(spark, folder).select(F.col("page").alias("source_url"), "person_id")


def p3_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a confidence."""
    return _linked(spark, folder).select(F.col("page").alias("source_url"), "person_id", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence}
SQL: dict[str, str] = {}
