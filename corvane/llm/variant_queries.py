"""Queries p2_*."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.survivor_queries import slug_form
from corvane.llm.variants import character_forms, date_level, place_key, place_names, reading_dictionary, typed_names, variant_groups, with_readings
from corvane.session import cut_lineage
from corvane.sources.tables import table


def people_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(`id`, `entity`: the slug, or the id where there is none, names, date and its level, place)."""
    columns = ["id", "slug", "primary_name", "name_ja", "name_zh", "name_en", "birth_date", "birth_date_precision", "birthplace"]
    rows = table(spark, folder, "people", *columns).distinct().where("id is not null")
    slug = slug_form(F.col("slug"))
    return rows.withColumn("entity", F.when(slug.isNull() | (slug == ""), F.col("id")).otherwise(slug)).withColumn("level", date_level(F.col("birth_date"), F.col("birth_date_precision")))


def people_names(rows: DataFrame, spark: SparkSession, folder: str, forms: dict[str, str], *, with_aliases: bool = True) -> tuple[DataFrame, DataFrame]:
    """The typed names of each entity with readings, and the dictionary of readings. Aliases are names like the others, in every script."""
    long = rows.select("entity", F.explode(F.array("primary_name", "name_ja", "name_zh", "name_en")).alias("name")).where("name is not null")
    names = cut_lineage(typed_names(long.distinct(), "entity", "name", forms).distinct())
    aliases = table(spark, folder, "person_aliases", "person_id", "name").distinct().join(rows.select("id", "entity").distinct(), F.col("person_id") == F.col("id")).select("entity", "name").distinct()
    if not with_aliases:
        aliases = aliases.where("name rlike '\\\\p{IsLatin}'")
    borne = cut_lineage(typed_names(aliases, "entity", "name", forms).distinct())
    # a full name in letters among the aliases tells how the name in characters is read; their characters may be those of another name
    dictionary = cut_lineage(reading_dictionary(names.unionByName(borne.where("kind = 'full' and latin")), "entity"))
    return with_readings(names.unionByName(borne).distinct() if with_aliases else names, dictionary), dictionary


def people_entities(rows: DataFrame, forms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(`entity`, `date`, `level`, `place`), and the Latin places with their native names."""
    placed = rows.withColumn("place", place_key(F.col("birthplace"), forms))
    same = cut_lineage(place_names(placed, "entity", "place"))
    best = placed.groupBy("entity").agg(F.max(F.struct("level", "birth_date")).alias("d"), F.max("place").alias("place"))
    e = best.join(same, "place", "left")
    return e.select("entity", F.when(F.col("d.level") > 0, F.col("d.birth_date")).alias("date"), F.col("d.level").alias("level"), F.coalesce("same", "place").alias("place")), same


def _groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(people_rows(spark, folder))
    forms = character_forms(rows, "name_ja", "name_zh")
    names, dictionary = people_names(rows, spark, folder, forms)
    entities, _ = people_entities(rows, forms)
    return rows, variant_groups(names, dictionary, entities)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each people row that stands for the same person as a row of another slug, with its group."""
    rows, groups = _groups(spark, folder)
    return rows.select("id", "entity", "primary_name").distinct().join(groups, "entity").select(F.col("id").alias("person_id"), F.col("group").alias("group_id"), "primary_name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one person under different slugs, the smaller id first."""
    rows, groups = _groups(spark, folder)
    member = cut_lineage(rows.select("id", "entity").distinct().join(groups, "entity"))
    a, b = member.alias("a"), member.alias("b")
    pairs = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.entity") != F.col("b.entity")))
    return pairs.select(F.col("a.id").alias("person_id_a"), F.col("b.id").alias("person_id_b")).distinct()


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
