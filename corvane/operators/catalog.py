"""The two denormalised views of the catalog, works and people, and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import initials, is_ascii
from corvane.operators.ranking import with_position
from corvane.sources.catalog_source import Tables

# Texts and labels of the views.
NO_MAKER, NO_SYNOPSIS, NO_BIOGRAPHY = "发行方待确认", "暂无公开简介。", "暂无公开简介。"
NO_EVENT_DETAIL, NO_DATE = "公开职业活动记录", "1900-01-01"
MEDIA = {"digital": "数字发行", "physical": "实体发行"}
NO_MEDIUM = "介质待确认"
EVENTS = {"debut": "出道", "retirement": "引退", "comeback": "复出"}
OTHER_EVENT = "职业记录"
ACTIVE, RETIRED, UNKNOWN = "活跃", "引退", "资料待确认"
WORK_TONES, PERSON_TONES = ["moon", "afternoon", "coast", "garden"], ["coral", "sage", "ink", "gold"]
LAST_BILLING = 999


def choose(value: Column, table: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def tone(position: Column, tones: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tones]), (position % len(tones) + 1).cast("int"))


def _gate(slug: str | None = None) -> Column:
    """The publication gate, of one slug where one is asked for."""
    open_rows = F.col("status") == "published"
    return open_rows if slug is None else open_rows & (F.col("slug") == slug)


def published(df: DataFrame) -> DataFrame:
    return df.where(_gate())


def latest_releases(releases: DataFrame) -> DataFrame:
    """Of each work the release with the latest date; releases without date come last, ties go to the smaller id.

    An aggregation, not a window: tasks send one release per work.
    """
    order = F.struct(F.col("release_date").isNull(), -F.unix_date("release_date"), F.col("id"))
    chosen = F.struct("code", "release_date", "runtime_minutes", "medium", "distributor_id")
    return releases.where("work_id is not null").groupBy(F.col("work_id").alias("id")).agg(F.min_by(chosen, order).alias("r")).select("id", "r.*")


def casts(credits: DataFrame, people: DataFrame) -> DataFrame:
    """Of each work the published people credited, in billing order (none counts as 999): names and ids.

    People credited several times in one work appear as often. Ties: credit type, then person. Only id and name of people are joined; a
    person credited by a large share of the rows is a skewed key of that join, which AQE splits.
    """
    named = credits.join(people.select(F.col("id").alias("person_id"), "primary_name"), "person_id")
    entry = F.struct(F.coalesce("billing_order", F.lit(LAST_BILLING)).alias("o"), "credit_type", "person_id", "primary_name")
    listed = named.groupBy(F.col("work_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return listed.select("id", F.col("c.primary_name").alias("cast"), F.col("c.person_id").alias("cast_ids"))


def _of(children: DataFrame, key: str, parents: DataFrame | None) -> DataFrame:
    """The children of some parents only, where a lookup has narrowed them."""
    return children if parents is None else children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def assemble_works(tables: Tables, *, tones: bool = False, slug: str | None = None) -> DataFrame:
    """The view of published works that have a release; with a slug, only the works of that slug.

    Nothing is computed before an action, and what a query doesn't ask for isn't read. `tones` adds `tone`, which turns with the position among
    all published works by original title, those without release included; that takes a total order of their ids and titles.
    """
    works = tables.rows("works", "id", "slug", "title_original", "title_zh", "synopsis", where=_gate(slug))
    found = None if slug is None else works
    makers = tables.rows("organizations", "id", "name_zh", "name").select(F.col("id").alias("distributor_id"), F.coalesce("name_zh", "name").alias("maker"))
    people = tables.rows("people", "id", "primary_name", where=_gate())
    releases = _of(tables.rows("releases", "id", "work_id", "code", "release_date", "runtime_minutes", "medium", "distributor_id"), "work_id", found)
    credits = _of(tables.rows("credits", "work_id", "person_id", "credit_type", "billing_order"), "work_id", found)
    w = works.join(latest_releases(releases), "id").join(makers, "distributor_id", "left").join(casts(credits, people), "id", "left")
    none = F.array().cast("array<string>")
    view = w.select(
        "id", "slug", "code",
        F.coalesce("title_zh", "title_original").alias("title"),
        F.col("title_original").alias("original_title"),
        F.coalesce(F.col("release_date").cast("string"), F.lit(NO_DATE)).alias("release_date"),
        F.coalesce(F.year("release_date"), F.lit(1900)).alias("release_year"),
        F.coalesce("maker", F.lit(NO_MAKER)).alias("maker"),
        F.coalesce("cast", none).alias("cast"),
        F.coalesce("cast_ids", none).alias("cast_ids"),
        F.coalesce("runtime_minutes", F.lit(0)).alias("runtime_minutes"),
        F.array(choose(F.col("medium"), MEDIA, NO_MEDIUM)).alias("tags"),
        F.coalesce("synopsis", F.lit(NO_SYNOPSIS)).alias("synopsis"),
    )
    return _with_tone(view, tables, "works", "title_original", WORK_TONES, slug) if tones else view


def _with_tone(view: DataFrame, tables: Tables, name: str, title: str, tones: list[str], slug: str | None) -> DataFrame:
    """`view` with `tone`. All positions at once need a total order; those of a few rows are counts of what comes before them."""
    ordered = tables.rows(name, "id", title, where=_gate())
    if slug is None:
        placed = with_position(ordered, "_at", F.col(title), F.col("id")).select("id", "_at")
        return view.join(placed, "id").withColumn("tone", tone(F.col("_at"), tones)).drop("_at")
    wanted = tables.rows(name, "id", title, where=_gate(slug)).toDF("_id", "_title")
    # one row for each bearer of the slug
    before = ordered.join(F.broadcast(wanted), F.struct(F.col(title), F.col("id")) < F.struct("_title", "_id")).groupBy("_id").agg(F.count("*").alias("_at"))
    return view.join(before, F.col("id") == F.col("_id"), "left").withColumn("tone", tone(F.coalesce("_at", F.lit(0)), tones)).drop("_id", "_at")


def timelines(events: DataFrame, people: DataFrame) -> DataFrame:
    """Of each person the events by year; an event without date takes the year in which the person was recorded."""
    dated = events.join(people.select(F.col("id").alias("person_id"), F.year("created_at").alias("_recorded")), "person_id")
    year = F.coalesce(F.year("event_date"), F.col("_recorded"))
    entry = F.struct(year.alias("year"), "created_at", "id", choose(F.col("type"), EVENTS, OTHER_EVENT).alias("label"), F.coalesce("note", F.lit(NO_EVENT_DETAIL)).alias("detail"))
    listed = dated.groupBy(F.col("person_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("t"), F.min(F.when(F.col("type") == "debut", year)).alias("debut"))
    return listed.select("id", F.transform("t", lambda x: F.struct(x["year"].alias("year"), x["label"].alias("label"), x["detail"].alias("detail"))).alias("timeline"), "debut")


def work_counts(credits: DataFrame, works: DataFrame) -> DataFrame:
    """Of each person the number of credits on published works, each credit type by itself."""
    return credits.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("work_count"))


def assemble_people(tables: Tables, *, tones: bool = False, slug: str | None = None) -> DataFrame:
    """The view of published people, those without credits included; with a slug, only the people of that slug. As for `tones`, see assemble_works()."""
    people = tables.rows("people", "id", "slug", "primary_name", "name_ja", "name_zh", "name_en", "biography", "active", "created_at", where=_gate(slug))
    found = None if slug is None else people
    alias = F.struct("created_at", "id", "name")
    named = _of(tables.rows("person_aliases", "id", "person_id", "name", "created_at"), "person_id", found)
    aliases = named.groupBy(F.col("person_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(alias)), lambda a: a["name"]).alias("aliases"))
    events = _of(tables.rows("career_events", "id", "person_id", "type", "event_date", "note", "created_at"), "person_id", found)
    credits = _of(tables.rows("credits", "work_id", "person_id", "credit_type"), "person_id", found)
    counts = work_counts(credits, tables.rows("works", "id", where=_gate()))
    p = people.join(aliases, "id", "left").join(timelines(events, people.select("id", "created_at")), "id", "left").join(counts, "id", "left")
    p = p.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("_recorded", F.year("created_at"))
    p = p.withColumn("romanized_name", F.coalesce(F.get(F.filter("aliases", is_ascii), 0), F.col("name_en"), F.col("primary_name")))
    view = p.select(
        "id", "slug",
        F.coalesce("name_zh", "primary_name").alias("name"),
        F.coalesce("name_ja", "primary_name").alias("original_name"),
        "romanized_name",
        status_text(F.col("active")).alias("status"),
        F.coalesce("debut", "_recorded").alias("debut_year"),
        F.coalesce("work_count", F.lit(0)).alias("work_count"),
        initials(F.col("romanized_name")).alias("initials"),
        "aliases",
        F.coalesce("biography", F.lit(NO_BIOGRAPHY)).alias("biography"),
        F.coalesce("timeline", F.array().cast("array<struct<year:int,label:string,detail:string>>")).alias("timeline"),
        "primary_name",
    )
    return _with_tone(view, tables, "people", "primary_name", PERSON_TONES, slug) if tones else view


def status_text(active: Column) -> Column:
    """The three states of a person by the column `active`."""
    return F.when(active, ACTIVE).when(~active, RETIRED).otherwise(UNKNOWN)


def status_value(text: Column) -> Column:
    """The column `active` of a shown state: NULL for the unknown one."""
    return F.when(text == ACTIVE, True).when(text == RETIRED, False)


class Catalog:
    """The read interface: both views, and records by slug with what belongs to them, from any source."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables

    def works(self) -> DataFrame:
        return assemble_works(self.tables, tones=True)

    def people(self) -> DataFrame:
        return assemble_people(self.tables, tones=True)

    def find_work(self, slug: str) -> DataFrame:
        """At most one work, the one with the smallest id."""
        return assemble_works(self.tables, tones=True, slug=slug).orderBy("id").limit(1)

    def find_person(self, slug: str) -> DataFrame:
        """At most one person, the one with the smallest id."""
        return assemble_people(self.tables, tones=True, slug=slug).orderBy("id").limit(1)

    def work_record(self, slug: str) -> DataFrame:
        """The work of find_work() with `people`, the views of its cast in billing order."""
        work, people = self.find_work(slug), assemble_people(self.tables)
        member = people_of_works(work, people).join(people, F.col("person_id") == F.col("id"))
        listed = member.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*people.columns).alias("v")))), lambda x: x["v"]).alias("people"))
        return work.join(listed, F.col("work_id") == F.col("id"), "left").drop("work_id")

    def person_record(self, slug: str) -> DataFrame:
        """The person of find_person() with `works`, the views of the works in whose cast they are, newest first."""
        person, works = self.find_person(slug), assemble_works(self.tables)
        linked = works_of_people(person, works).join(works, F.col("work_id") == F.col("id"))
        newest = F.struct(F.col("release_date"), F.struct(*works.columns).alias("v"))
        listed = linked.groupBy("person_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(newest))), lambda x: x["v"]).alias("works"))
        return person.join(listed, F.col("person_id") == F.col("id"), "left").drop("person_id")


def slug_ids(rows: DataFrame, slugs: DataFrame) -> DataFrame:
    """(`slug`, `id`) of the slugs asked for that exist; of several bearers the smallest id."""
    return rows.join(slugs.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.min("id").alias("id"))


def detail_medium(tags: Column) -> Column:
    """The medium on a work's page; an unknown one shows as digital there."""
    return F.when(F.array_contains(tags, MEDIA["physical"]), "实体").otherwise("数字")


def detail_confidence(status: Column) -> Column:
    """Whether a person's page counts as confirmed: not while the state is unknown."""
    return F.when(status == UNKNOWN, "待审核").otherwise("已确认")


def page_title(found: DataFrame, name: str, missing: str) -> DataFrame:
    """One row with `title`: the column `name` of the row found, or `missing` where there is none."""
    return found.agg(F.coalesce(F.first(name, ignorenulls=True), F.lit(missing)).alias("title"))


def slugs(rows: DataFrame) -> DataFrame:
    """The slugs that have a page."""
    return rows.select("slug").where("slug is not null").distinct()


def valid_at(aliases: DataFrame, day: Column) -> DataFrame:
    """Aliases that held on a day: open ends hold, the last day of a period doesn't."""
    return aliases.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))


def last_releases(credits: DataFrame, releases: DataFrame) -> DataFrame:
    """(`person_id`, `last_release`): the latest release of any work that credits the person; people without a dated one have NULL."""
    latest = releases.groupBy("work_id").agg(F.max("release_date").alias("_last"))
    return credits.select("work_id", "person_id").distinct().join(latest, "work_id").groupBy("person_id").agg(F.max("_last").alias("last_release"))


def works_of_people(people: DataFrame, works: DataFrame, link_by: str = "id") -> DataFrame:
    """(`person_id`, `work_id`) of people with the works in whose cast they are, each once.

    link_by: `id`, or `name` for comparing the shown name with the cast's names, which loses people whose shown name isn't their primary one.
    """
    member, key = ("cast_ids", "id") if link_by == "id" else ("cast", "name")
    listed = works.select(F.col("id").alias("work_id"), F.explode(member).alias("_member"))
    return people.select(F.col("id").alias("person_id"), F.col(key).alias("_key")).join(listed, F.col("_key") == F.col("_member")).select("person_id", "work_id").distinct()


def people_of_works(works: DataFrame, people: DataFrame, order: str = "billing") -> DataFrame:
    """(`work_id`, `person_id`, `place` from 0) of the cast: in billing order, or by primary name."""
    listed = works.select(F.col("id").alias("work_id"), F.posexplode("cast_ids").alias("_at", "person_id")).groupBy("work_id", "person_id").agg(F.min("_at").alias("_at"))
    known = listed.join(people.select(F.col("id").alias("person_id"), F.col("primary_name").alias("_name")), "person_id")
    key = F.struct("_at", "person_id") if order == "billing" else F.struct("_name", "person_id")
    ranked = known.groupBy("work_id").agg(F.array_sort(F.collect_list(key)).alias("c")).select("work_id", F.posexplode("c").alias("place", "m"))
    return ranked.select("work_id", F.col("m.person_id").alias("person_id"), "place")
