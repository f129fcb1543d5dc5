"""Directories of works and people: filters, search, completeness, orders, facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.search import search
from corvane.functions.text import numeric_key
from corvane.operators.ranking import with_position

#: The value of a filter that is off.
ALL = "全部"
WORK_SORTS = ("relevance", "release-newest", "release-oldest", "name", "code")
PEOPLE_SORTS = ("relevance", "debut-newest", "debut-oldest", "name")
PEOPLE_STATUS = ("活跃", "引退", "资料待确认")


class _Params:
    """To and from URL parameters: fields that are at their default aren't written."""

    def to_params(self) -> dict[str, str]:
        return {f.name: str(getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) != f.default and f.name != "favorites_only"}

    @classmethod
    def from_params(cls, params: Mapping[str, str]):
        known = {f.name for f in fields(cls)} - {"favorites_only"}
        return cls(**{k: v for k, v in params.items() if k in known and v})


@dataclass(frozen=True)
class WorksFilter(_Params):
    q: str = ""
    year: str = ALL
    maker: str = ALL
    tag: str = ALL
    cast: str = ALL
    exclude_tag: str = ALL
    exclude_cast: str = ALL
    sort: str = "relevance"
    favorites_only: bool = False


@dataclass(frozen=True)
class PeopleFilter(_Params):
    q: str = ""
    status: str = ALL
    debut: str = ALL
    sort: str = "relevance"
    favorites_only: bool = False


def facet(df: DataFrame, column: str, *, descending: bool = False) -> DataFrame:
    """The different values of a column, of an array's elements too, in order: numbers by size, text by Chinese order, equals by code point."""
    value = F.explode(column) if dict(df.dtypes)[column].startswith("array") else F.col(column)
    values = df.select(value.alias("value")).where("value is not null").distinct()
    keys = [chinese_order(F.col("value")), F.col("value")] if dict(values.dtypes)["value"] == "string" else [F.col("value")]
    return values.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def chinese_order(value: Column) -> Column:
    """Order of Chinese text by reading."""
    return F.collate(value, "zh")


def _carried(df: DataFrame, column: str, value: str) -> bool:
    test = F.array_contains(column, value) if dict(df.dtypes)[column].startswith("array") else F.col(column).cast("string") == value
    return not df.where(test).limit(1).isEmpty()


def checked_works_filter(works: DataFrame, f: WorksFilter) -> WorksFilter:
    """The filter without values that no work carries, and with a known order."""
    columns = {"year": "release_year", "maker": "maker", "tag": "tags", "cast": "cast", "exclude_tag": "tags", "exclude_cast": "cast"}
    off = {name: ALL for name, column in columns.items() if (v := getattr(f, name)) != ALL and not _carried(works, column, v)}
    return replace(f, **off, sort=f.sort if f.sort in WORK_SORTS else "relevance")


def checked_people_filter(people: DataFrame, f: PeopleFilter) -> PeopleFilter:
    off = {} if f.debut == ALL or _carried(people, "debut_year", f.debut) else {"debut": ALL}
    return replace(f, **off, status=f.status if f.status in PEOPLE_STATUS else ALL, sort=f.sort if f.sort in PEOPLE_SORTS else "relevance")


def work_completeness() -> Column:
    return (F.length("synopsis") > 0).cast("int") + F.size("cast") + F.size("tags") + (F.length("maker") > 0).cast("int")


def person_completeness() -> Column:
    return (F.length("biography") > 0).cast("int") + F.size("aliases") + F.size("timeline")


def work_values(*, with_tags: bool = True) -> Column:
    """What search looks at in a work, in order; the first page begins with the code and leaves tags out."""
    if with_tags:
        return F.concat(F.array("title", "original_title", "code", "maker"), "cast", "tags")
    return F.concat(F.array("code", "title", "original_title", "maker"), "cast")


def person_values(*, with_aliases: bool = True) -> Column:
    names = F.array("name", "original_name", "romanized_name")
    return F.concat(names, F.col("aliases")) if with_aliases else names


def filter_works(works: DataFrame, f: WorksFilter, favorites: DataFrame | None = None) -> DataFrame:
    """Works that satisfy all filters and the search, with `match` and `completeness`.

    Cheap predicates come first, so that search sees only what they leave. favorites: (`entity_id`).
    """
    on = lambda v: v != ALL
    df = works
    if on(f.year):
        df = df.where(F.col("release_year") == int(f.year))
    if on(f.maker):
        df = df.where(F.col("maker") == f.maker)
    for column, wanted, unwanted in (("tags", f.tag, f.exclude_tag), ("cast", f.cast, f.exclude_cast)):
        if on(wanted):
            df = df.where(F.array_contains(column, wanted))
        if on(unwanted):
            df = df.where(~F.array_contains(column, unwanted))
    if f.favorites_only and favorites is not None:
        df = df.join(favorites.select(F.col("entity_id").alias("id")), "id", "left_semi")
    return search(df, f.q, work_values()).withColumn("completeness", work_completeness())


def filter_people(people: DataFrame, f: PeopleFilter, favorites: DataFrame | None = None) -> DataFrame:
    df = people
    if f.status != ALL:
        df = df.where(F.col("status") == f.status)
    if f.debut != ALL:
        df = df.where(F.col("debut_year") == int(f.debut))
    if f.favorites_only and favorites is not None:
        df = df.join(favorites.select(F.col("entity_id").alias("id")), "id", "left_semi")
    return search(df, f.q, person_values()).withColumn("completeness", person_completeness())


def _work_place() -> list[Column]:
    """The catalog's order of works."""
    return [F.col("original_title").asc(), F.col("id").asc()]


def _person_place() -> list[Column]:
    """The catalog's order of people."""
    return [F.col("primary_name").asc(), F.col("id").asc()]


def work_order(sort: str) -> list[Column]:
    """The order of filtered works; equal rows keep the catalog's order."""
    keys = {
        "release-newest": [F.col("release_date").desc()],
        "release-oldest": [F.col("release_date").asc()],
        "name": [chinese_order(F.col("title")).asc()],
        "code": [chinese_order(F.col("code")).asc()],
    }.get(sort, [F.coalesce(F.col("match.score"), F.lit(0)).desc(), F.col("completeness").desc(), F.col("release_date").desc()])
    return [*keys, *_work_place()]


def people_order(sort: str) -> list[Column]:
    name = chinese_order(F.col("name")).asc()
    keys = {"debut-newest": [F.col("debut_year").desc()], "debut-oldest": [F.col("debut_year").asc()], "name": [name]}.get(sort, [F.coalesce(F.col("match.score"), F.lit(0)).desc(), F.col("completeness").desc(), name])
    return [*keys, *_person_place()]


def related_order(sort: str) -> list[Column]:
    """The order of a person's works; names and codes compare digits as numbers and ignore case and accents."""
    keys = {"oldest": [F.col("release_date").asc()], "name": [chinese_order(numeric_key(F.col("title"))).asc()], "code": [chinese_order(numeric_key(F.col("code"))).asc()]}.get(sort, [F.col("release_date").desc()])
    return [*keys, *_work_place()]


def works_page(works: DataFrame, f: WorksFilter, favorites: DataFrame | None = None) -> DataFrame:
    checked = checked_works_filter(works, f)
    return filter_works(works, checked, favorites).orderBy(*work_order(checked.sort))


def people_page(people: DataFrame, f: PeopleFilter, favorites: DataFrame | None = None) -> DataFrame:
    checked = checked_people_filter(people, f)
    return filter_people(people, checked, favorites).orderBy(*people_order(checked.sort))


def placed_works(works: DataFrame, f: WorksFilter, favorites: DataFrame | None = None) -> DataFrame:
    """The works of works_page() with their `place` in it, from 0, instead of one sorted whole."""
    checked = checked_works_filter(works, f)
    return with_position(filter_works(works, checked, favorites), "place", *work_order(checked.sort))


def placed_people(people: DataFrame, f: PeopleFilter, favorites: DataFrame | None = None) -> DataFrame:
    """The people of people_page() with their `place` in it, from 0."""
    checked = checked_people_filter(people, f)
    return with_position(filter_people(people, checked, favorites), "place", *people_order(checked.sort))


def related_places(links: DataFrame, works: DataFrame, sort: str) -> DataFrame:
    """(`person_id`, `work_id`, `place` from 0) of each person's works (`person_id`, `work_id`) in one of the orders of related works."""
    keys = related_order(sort)
    named = works.select(F.col("id").alias("work_id"), F.col("id"), "title", "original_title", "code", "release_date")
    window = Window.partitionBy("person_id").orderBy(*keys)
    return links.join(named, "work_id").select("person_id", "work_id", (F.row_number().over(window) - 1).alias("place"))


def any_tag(works: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Works with at least one of several tags."""
    return works.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")))


def result_count(page: DataFrame) -> DataFrame:
    """One row with `count`, how many rows a page's filters leave."""
    return page.agg(F.count("*").alias("count"))


def home_search(people: DataFrame, works: DataFrame, query: str) -> DataFrame:
    """(`kind`, `id`, `label`): people, then works that the query finds, each in the catalog's order."""
    p = search(people, query, person_values(with_aliases=False)).select(F.lit(0).alias("_kind"), F.lit("person").alias("kind"), "id", F.col("name").alias("label"), F.col("primary_name").alias("_place"))
    w = search(works, query, work_values(with_tags=False)).select(F.lit(1).alias("_kind"), F.lit("work").alias("kind"), "id", F.col("title").alias("label"), F.col("original_title").alias("_place"))
    return p.unionByName(w).orderBy("_kind", "_place", "id").drop("_kind", "_place")


def with_favorite(df: DataFrame, favorites: DataFrame) -> DataFrame:
    """`df` with `is_favorite`."""
    marked = favorites.select(F.col("entity_id").alias("id")).distinct().withColumn("_marked", F.lit(True))
    return df.join(marked, "id", "left").withColumn("is_favorite", F.col("_marked").isNotNull()).drop("_marked")


def filter_state(f: WorksFilter | PeopleFilter) -> dict[str, object]:
    return asdict(f)
