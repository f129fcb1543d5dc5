"""Idempotent loading: upserts, replaced children, cascading deletes, nested views to rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, incoming: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """`target` merged with `incoming` on `key`: rows in both take only the columns `update` from the incoming one, new rows come whole.

    Keys are unique on either side and not NULL.
    """
    t, i = target.alias("t"), incoming.alias("i")
    both = t.join(i, F.col(f"t.{key}") == F.col(f"i.{key}"), "full_outer")
    old, new = F.col(f"t.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()

    def merged(c: str):
        if c not in incoming.columns:
            return F.col(f"t.{c}")
        if c in update:
            return F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        return F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"i.{c}")).alias(c)

    return both.select(*[merged(c) for c in target.columns])


def replace_children(children: DataFrame, incoming: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """`children` without those of the parents at hand (all keys of `incoming`, and of `parents`), plus `incoming`."""
    keys = incoming.select(key)
    if parents is not None:
        keys = keys.unionByName(parents.select(key))
    return children.join(keys.distinct(), key, "left_anti").select(*children.columns).unionByName(incoming.select(*children.columns))


def cascade_delete(children: DataFrame, foreign_key: str, deleted: DataFrame, key: str = "id") -> DataFrame:
    """`children` without those whose parent was deleted."""
    gone = deleted.select(F.col(key).alias(foreign_key)).distinct()
    return children.join(gone, foreign_key, "left_anti").select(*children.columns)


def cast_rows(works: DataFrame, people: DataFrame) -> DataFrame:
    """Credits (`work_id`, `person_id`, `billing_order` from 1) of nested casts; names that no person bears are dropped."""
    listed = works.select(F.col("id").alias("work_id"), F.posexplode("cast").alias("_at", "_name"))
    named = people.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("person_id"))
    return listed.join(named, "_name").select("work_id", "person_id", (F.col("_at") + 1).alias("billing_order"))


def alias_rows(people: DataFrame) -> DataFrame:
    """Aliases (`person_id`, `name`, `language`) of nested views; those all in ASCII count as English, the rest as Japanese."""
    each = people.select(F.col("id").alias("person_id"), F.explode("aliases").alias("name"))
    return each.withColumn("language", F.when(F.col("name").rlike(r"^[\x00-\x7F]+\z"), "en").otherwise("ja"))


def event_rows(people: DataFrame) -> DataFrame:
    """Career events (`person_id`, `type`, `event_date`, `date_precision`, `note`) of nested timelines; years become 1 January."""
    each = people.select(F.col("id").alias("person_id"), F.explode("timeline").alias("t"))
    kind = F.when(F.col("t.label") == "出道", "debut").when(F.col("t.label") == "引退", "retirement").when(F.col("t.label") == "复出", "comeback").otherwise("other")
    return each.select("person_id", kind.alias("type"), F.make_date(F.col("t.year"), F.lit(1), F.lit(1)).alias("event_date"), F.lit("year").alias("date_precision"), F.col("t.detail").alias("note"))


def sequence_id(space: str, number) -> object:
    """A made-up id that depends only on a name space and a number."""
    return F.concat(F.lit(f"00000000-0000-4000-{space}-"), F.lpad(number.cast("string"), 12, "0"))


def resolve_slugs(rows: DataFrame, persisted: DataFrame, slug: str = "slug") -> DataFrame:
    """`rows` with `id`, the id that the persisted row of their slug bears; rows of slugs that aren't persisted are dropped, of several bearers the smallest id holds."""
    ids = persisted.where("slug is not null").groupBy(F.col("slug").alias(slug)).agg(F.min("id").alias("id"))
    return rows.drop("id").join(ids, slug)


def _move(fs, source, target) -> None:
    """Renames, or raises: a file system may tell of a failure by returning false only."""
    if not fs.rename(source, target) or not fs.exists(target):
        raise OSError(f"couldn't move {source} to {target}")


def write_all(spark: SparkSession, tables: dict[str, DataFrame], folder: str, fs=None) -> None:
    """Writes all tables into a new folder beside the old one and exchanges them.

    A failure while writing changes nothing. If the exchange fails, the old folder is moved back; it is deleted only
    after the new one is in its place, and if it can't be moved back the error names where it is.
    """
    place = folder.rstrip("/")
    staged = f"{place}.{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs or path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old, target = path(staged), path(f"{staged}.old"), path(place)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}.parquet")
    except BaseException:
        fs.delete(new, True)
        raise
    had = fs.exists(target)
    if had:
        try:
            _move(fs, target, old)
        except BaseException:
            if fs.exists(target):
                fs.delete(new, True)
            raise
    try:
        _move(fs, new, target)
    except BaseException as e:
        if had:
            try:
                if not fs.exists(target):
                    _move(fs, old, target)
            except BaseException as again:
                raise OSError(f"the old tables are in {old}, the new ones in {new}") from again
        fs.delete(new, True)
        raise OSError(f"{target} is as it was before") from e
    if had:
        fs.delete(old, True)
