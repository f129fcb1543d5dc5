"""Queries on the two views, their links, directories and facets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import dotted_date, numeric_key, ordinal
from corvane.operators import catalog as c
from corvane.operators import directory as d
from corvane.sources.catalog_source import ParquetTables


class _Tables(ParquetTables):
    """The supplied tables; the two that aren't supplied are made of others: organizations of the releases' distributors, career events of people's snapshots."""

    def _load(self, name: str) -> DataFrame | None:
        if name == "organizations":
            held = super()._load("releases").select(F.col("distributor_id").alias("id")).where("id is not null").distinct()
            native = F.when(F.substring("id", 1, 1) < "8", F.concat(F.lit("厂"), F.substring("id", 1, 6)))
            return held.select("id", F.col("id").alias("slug"), F.lit("maker").alias("type"), F.concat(F.lit("Maker "), F.substring("id", 1, 6)).alias("name"), native.alias("name_zh"))
        if name == "career_events":
            seen = super()._load("people_snapshots")
            kinds = F.array(*[F.lit(k) for k in ("debut", "retirement", "comeback", "hiatus", "other")])
            kind = F.element_at(kinds, (F.col("snapshot_id") % 5 + 1).cast("int"))
            return seen.select(F.col("snapshot_id").cast("string").alias("id"), "person_id", kind.alias("type"), F.when(F.col("snapshot_id") % 7 != 0, F.col("snapshot_date")).alias("event_date"), F.col("stage_name").alias("note"), F.col("received_at").alias("created_at"))
        return super()._load(name)


def _tables(spark: SparkSession, folder: str) -> ParquetTables:
    return _Tables(spark, folder)


def _works(spark: SparkSession, folder: str, **options) -> DataFrame:
    return c.assemble_works(_tables(spark, folder), **options)


def _people(spark: SparkSession, folder: str, **options) -> DataFrame:
    return c.assemble_people(_tables(spark, folder), **options)


def _flat_works(df: DataFrame) -> DataFrame:
    return df.select("id", "slug", "code", "title", "original_title", "release_date", "release_year", "maker", F.array_join("cast", "、").alias("cast"), "tone", "runtime_minutes", F.array_join("tags", "、").alias("tags"), "synopsis")


def _flat_people(df: DataFrame) -> DataFrame:
    return df.select("id", "slug", "name", "original_name", "romanized_name", "status", "debut_year", "work_count", "initials", "tone", F.array_join("aliases", "、").alias("aliases"), "biography", _shown_timeline().alias("timeline"))


def _shown_timeline():
    return F.array_join(F.transform("timeline", lambda x: F.concat_ws(":", x["year"].cast("string"), x["label"], x["detail"])), "|")


def catalog_works(spark, folder):
    """All works."""
    return _flat_works(_works(spark, folder, tones=True))


def catalog_people(spark, folder):
    """All people."""
    return _flat_people(_people(spark, folder, tones=True))


def published_scan(spark, folder):
    """The publication gate alone."""
    return _tables(spark, folder).rows("works", "id", "slug", "title_original", where="status = 'published'")


def _published_ids(t, name: str) -> DataFrame:
    return t.rows(name, "id", where="status = 'published'")


def child_semi_scan(spark, folder):
    """Releases of published works."""
    t = _tables(spark, folder)
    return t.rows("releases", "id", "work_id", "code").join(_published_ids(t, "works").select(F.col("id").alias("work_id")), "work_id", "left_semi").select("id", "work_id", "code")


def _releases(t) -> DataFrame:
    return t.rows("releases", "id", "work_id", "code", "release_date", "runtime_minutes", "medium", "distributor_id")


def latest_release_per_work(spark, folder):
    """The latest release of each work that has one."""
    return c.latest_releases(_releases(_tables(spark, folder))).select("id", "code", F.col("release_date").cast("string").alias("release_date"))


def works_without_release(spark, folder):
    """Published works that the view drops."""
    t = _tables(spark, folder)
    return _published_ids(t, "works").join(t.rows("releases", "id", "work_id").select(F.col("work_id").alias("id")), "id", "left_anti").select("id")


def ordered_cast_list(spark, folder):
    """Casts in billing order."""
    t = _tables(spark, folder)
    credits = t.rows("credits", "work_id", "person_id", "credit_type", "billing_order")
    return c.casts(credits, t.rows("people", "id", "primary_name", where="status = 'published'")).select("id", F.array_join("cast", "、").alias("cast"))


def credit_count_per_person(spark, folder):
    """Credits on published works of each published person, 0 included."""
    t = _tables(spark, folder)
    counts = c.work_counts(t.rows("credits", "work_id", "person_id"), _published_ids(t, "works"))
    return _published_ids(t, "people").join(counts, "id", "left").select("id", F.coalesce("work_count", F.lit(0)).alias("work_count"))


def related_works_by_person(spark, folder):
    """Each person's works."""
    return c.works_of_people(_people(spark, folder), _works(spark, folder))


def related_works_by_name(spark, folder):
    """The same by shown name, as the relational source links."""
    return c.works_of_people(_people(spark, folder), _works(spark, folder), "name")


def cast_of_work_billing(spark, folder):
    """Each work's people in billing order."""
    return c.people_of_works(_works(spark, folder), _people(spark, folder))


def cast_of_work_names(spark, folder):
    """Each work's people by name."""
    return c.people_of_works(_works(spark, folder), _people(spark, folder), "name")


def facet_years(spark, folder):
    return d.facet(_works(spark, folder), "release_year", descending=True)


def facet_makers(spark, folder):
    return d.facet(_works(spark, folder), "maker")


def facet_tags(spark, folder):
    return d.facet(_works(spark, folder), "tags")


def facet_cast(spark, folder):
    return d.facet(_works(spark, folder), "cast")


def facet_debut_years(spark, folder):
    return d.facet(_people(spark, folder), "debut_year", descending=True)


def filter_combo(spark, folder):
    """Year and tag together."""
    return d.filter_works(_works(spark, folder), d.WorksFilter(year="2020", tag="数字发行")).select("id", "completeness")


def filter_exclude(spark, folder):
    """All but one tag."""
    return d.filter_works(_works(spark, folder), d.WorksFilter(exclude_tag="数字发行")).select("id")


def domain_checked_filter(spark, folder):
    """A year that no work carries is ignored."""
    works = _works(spark, folder)
    return d.filter_works(works, d.checked_works_filter(works, d.WorksFilter(year="1492", tag="实体发行"))).select("id")


def status_filter(spark, folder):
    """Retired people."""
    return d.filter_people(_people(spark, folder), d.PeopleFilter(status=c.RETIRED)).select("id", "debut_year")


def favorites_only(spark, folder):
    """Works among favourites: here those with more than one release."""
    t = _tables(spark, folder)
    liked = t.rows("releases", "id", "work_id").groupBy(F.col("work_id").alias("entity_id")).agg(F.count("*").alias("n")).where("n > 1").select("entity_id")
    return d.filter_works(c.assemble_works(t), d.WorksFilter(favorites_only=True), liked).select("id")


def favorite_flag(spark, folder):
    """The same as a flag of each work."""
    t = _tables(spark, folder)
    liked = t.rows("releases", "id", "work_id").groupBy(F.col("work_id").alias("entity_id")).agg(F.count("*").alias("n")).where("n > 1").select("entity_id")
    return d.with_favorite(c.assemble_works(t), liked).select("id", "is_favorite")


def completeness_works(spark, folder):
    return _works(spark, folder).select("id", d.work_completeness().alias("completeness"))


def completeness_people(spark, folder):
    return _people(spark, folder).select("id", d.person_completeness().alias("completeness"))


def works_newest_first(spark, folder):
    """Each work's place when sorted by date, newest first."""
    return d.placed_works(_works(spark, folder), d.WorksFilter(sort="release-newest")).select("id", ordinal(F.col("place") + 1).alias("ordinal"))


def related_numeric_order(spark, folder):
    """The key by which codes sort with their digits as numbers."""
    return _works(spark, folder).select("id", numeric_key(F.col("code")).alias("code_key"))


def format_release_date(spark, folder):
    return _tables(spark, folder).rows("releases", "id", "release_date").select("id", dotted_date(F.col("release_date")).alias("shown"))


def alias_valid_at(spark, folder):
    """Aliases that held on a day, open ends included."""
    a = _tables(spark, folder).rows("person_aliases", "id", "person_id", "name", "valid_from", "valid_to")
    return c.valid_at(a, F.lit("2018-01-01").cast("date")).select("id", "person_id", "name")


def last_release_per_person(spark, folder):
    """The last release date of each credited person."""
    t = _tables(spark, folder)
    return c.last_releases(t.rows("credits", "work_id", "person_id"), t.rows("releases", "id", "work_id", "release_date")).select("person_id", F.col("last_release").cast("string").alias("last_release"))


def or_within_group(spark, folder):
    """Works with any of several tags."""
    return d.any_tag(_works(spark, folder), ["数字发行", "实体发行"]).select("id")


def works_page_relevance(spark, folder):
    """The works that a search finds, at their places by relevance."""
    page = d.placed_works(_works(spark, folder), d.WorksFilter(q="Ｖol.2"))
    return page.select("id", F.col("place").cast("int").alias("place"), F.col("match.kind").alias("kind"), F.col("match.score").alias("score"), F.col("match.value").alias("value"))


def _first_cast(works: DataFrame) -> str:
    return works.select(F.explode("cast").alias("n")).agg(F.min("n")).first()[0] or d.ALL


def works_page_oldest(spark, folder):
    """The works of no known maker without one person, oldest first."""
    works = _works(spark, folder)
    return d.placed_works(works, d.WorksFilter(maker=c.NO_MAKER, exclude_cast=_first_cast(works), sort="release-oldest")).select("id", F.col("place").cast("int").alias("place"))


def works_page_cast(spark, folder):
    """The works of one person, newest first."""
    works = _works(spark, folder)
    return d.placed_works(works, d.WorksFilter(cast=_first_cast(works), sort="release-newest")).select("id", F.col("place").cast("int").alias("place"))


def works_page_count(spark, folder):
    """How many works have one medium."""
    return d.result_count(d.filter_works(_works(spark, folder), d.WorksFilter(tag="数字发行")))


def people_page_relevance(spark, folder):
    """The people that a search finds, aliases included, with the hit shown; several typing errors are forgiven."""
    page = d.filter_people(_people(spark, folder), d.PeopleFilter(q="tsubaki"))
    return page.select("id", "completeness", F.col("match.kind").alias("kind"), F.col("match.score").alias("score"), F.col("match.value").alias("value"))


def people_page_debut(spark, folder):
    """Active people at their places, latest debut first."""
    return d.placed_people(_people(spark, folder), d.PeopleFilter(status=c.ACTIVE, sort="debut-newest")).select("id", F.col("place").cast("int").alias("place"), "debut_year")


def people_page_debut_oldest(spark, folder):
    """People of one debut year at their places."""
    return d.placed_people(_people(spark, folder), d.PeopleFilter(debut="2019", sort="debut-oldest")).select("id", F.col("place").cast("int").alias("place"))


def home_search(spark, folder):
    """People, then works that the home page's search finds."""
    return d.home_search(_people(spark, folder), _works(spark, folder), "maki")


def timelines(spark, folder):
    """Each person's events by year, one row for each, and the debut."""
    t = _tables(spark, folder)
    events = t.rows("career_events", "id", "person_id", "type", "event_date", "note", "created_at")
    made = c.timelines(events, t.rows("people", "id", "created_at", where="status = 'published'"))
    return made.select("id", "debut", F.posexplode("timeline").alias("place", "e")).select("id", "debut", "place", "e.year", "e.label", "e.detail")


def makers(spark, folder):
    """Each work's maker, by the default where none is known."""
    return _works(spark, folder).select("id", "maker")


def search_vectors(spark, folder):
    """What search looks at in each work."""
    return _works(spark, folder).select("id", F.array_join(d.work_values(), "|").alias("searched"))


def person_vectors(spark, folder):
    """What search looks at in each person."""
    return _people(spark, folder).select("id", F.array_join(d.person_values(), "|").alias("searched"))


def related_places_oldest(spark, folder):
    """Each person's works at their places, oldest first."""
    works = _works(spark, folder)
    return d.related_places(c.works_of_people(_people(spark, folder), works), works, "oldest")


def _first_slug(spark, folder, view: str) -> str:
    t = _tables(spark, folder)
    rows = t.rows("works", "id", "slug", where="status = 'published'")
    if view == "work":
        return rows.join(t.rows("releases", "id", "work_id").select(F.col("work_id").alias("id")), "id", "left_semi").agg(F.min("slug")).first()[0]
    return t.rows("people", "id", "slug", where="status = 'published'").agg(F.min("slug")).first()[0]


def work_record(spark, folder):
    """One work by slug with its cast."""
    r = c.Catalog(_tables(spark, folder)).work_record(_first_slug(spark, folder, "work"))
    return r.select("id", "tone", F.array_join(F.transform("people", lambda p: p["id"]), ",").alias("people"))


def person_record(spark, folder):
    """One person by slug with their works."""
    r = c.Catalog(_tables(spark, folder)).person_record(_first_slug(spark, folder, "person"))
    return r.select("id", "tone", F.array_join(F.array_sort(F.transform("works", lambda w: w["id"])), ",").alias("works"))


def work_page_title(spark, folder):
    """The title of a page, found or not."""
    catalog = c.Catalog(_tables(spark, folder))
    found = c.page_title(catalog.find_work(_first_slug(spark, folder, "work")), "title", "作品不存在")
    return found.unionByName(c.page_title(catalog.find_work("no such slug"), "title", "作品不存在"))


def detail_medium(spark, folder):
    return _works(spark, folder).select("id", c.detail_medium(F.col("tags")).alias("medium"))


def detail_confidence(spark, folder):
    return _people(spark, folder).select("id", c.detail_confidence(F.col("status")).alias("confidence"))


def page_slugs(spark, folder):
    """The slugs that have a page."""
    return c.slugs(_works(spark, folder))


def status_three_valued(spark, folder):
    """The three states of people, unknown among them, as shown and read back."""
    shown = _tables(spark, folder).rows("people", "id", "active").withColumn("state", c.status_text(F.col("active")))
    return shown.select("id", "state", c.status_value(F.col("state")).alias("active"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Works that a search finds among those not only physical, most relevant first."""
    works = _works(spark, folder, tones=True)
    return _flat_works(d.works_page(works, d.WorksFilter(q="vol.2", exclude_tag="实体发行")))


_BASE = """WITH pe AS (SELECT DISTINCT * FROM people), wo AS (SELECT DISTINCT * FROM works), re AS (SELECT DISTINCT * FROM releases), cr AS (SELECT DISTINCT * FROM credits), al AS (SELECT DISTINCT * FROM person_aliases),
pw AS (SELECT *, row_number() OVER (ORDER BY title_original, id) - 1 AS position FROM wo WHERE status = 'published'),
pp AS (SELECT *, row_number() OVER (ORDER BY primary_name, id) - 1 AS position FROM pe WHERE status = 'published'),
lr AS (SELECT * FROM re WHERE work_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY release_date DESC NULLS LAST, id) = 1),
ca AS (SELECT cr.work_id, pp.id AS person_id, primary_name, row_number() OVER (PARTITION BY work_id ORDER BY coalesce(billing_order, 999), credit_type NULLS FIRST, pp.id, primary_name) AS o FROM cr JOIN pp ON pp.id = cr.person_id),
cl AS (SELECT work_id, string_agg(primary_name, '、' ORDER BY o) AS names, list(primary_name ORDER BY o) AS members, count(*) AS size FROM ca GROUP BY 1),
og AS (SELECT DISTINCT distributor_id AS id, CASE WHEN distributor_id[1] < '8' THEN '厂' || distributor_id[1:6] ELSE 'Maker ' || distributor_id[1:6] END AS maker FROM releases WHERE distributor_id IS NOT NULL),
ev AS (SELECT DISTINCT CAST(snapshot_id AS VARCHAR) AS id, person_id, ['debut', 'retirement', 'comeback', 'hiatus', 'other'][snapshot_id % 5 + 1] AS type, CASE WHEN snapshot_id % 7 <> 0 THEN snapshot_date END AS event_date, stage_name AS note, received_at AS created_at FROM people_snapshots),
et AS (SELECT ev.*, pp.id AS owner, coalesce(year(event_date), year(pp.created_at)) AS year, CASE type WHEN 'debut' THEN '出道' WHEN 'retirement' THEN '引退' WHEN 'comeback' THEN '复出' ELSE '职业记录' END AS label, coalesce(note, '公开职业活动记录') AS detail FROM ev JOIN pp ON pp.id = ev.person_id),
tl AS (SELECT owner, string_agg(year || ':' || label || ':' || detail, '|' ORDER BY year, created_at, id, label, detail) AS timeline, count(*) AS events, min(year) FILTER (type = 'debut') AS debut FROM et GROUP BY 1),
w AS (SELECT pw.id, pw.slug, lr.code, coalesce(title_zh, title_original) AS title, title_original AS original_title, coalesce(strftime(release_date, '%Y-%m-%d'), '1900-01-01') AS release_date,
  coalesce(year(release_date), 1900) AS release_year, coalesce(og.maker, '发行方待确认') AS maker, coalesce(cl.members, []) AS members, coalesce(cl.names, '') AS "cast", coalesce(cl.size, 0) AS cast_size,
  ['moon', 'afternoon', 'coast', 'garden'][position % 4 + 1] AS tone, coalesce(runtime_minutes, 0) AS runtime_minutes,
  CASE medium WHEN 'digital' THEN '数字发行' WHEN 'physical' THEN '实体发行' ELSE '介质待确认' END AS tags, coalesce(synopsis, '暂无公开简介。') AS synopsis, position
  FROM pw JOIN lr ON lr.work_id = pw.id LEFT JOIN cl ON cl.work_id = pw.id LEFT JOIN og ON og.id = lr.distributor_id),
ag AS (SELECT person_id, list(name ORDER BY created_at, id, name) AS names FROM al GROUP BY 1),
wc AS (SELECT person_id, count(*) AS n FROM cr WHERE work_id IN (SELECT id FROM pw) GROUP BY 1),
p0 AS (SELECT pp.*, debut, coalesce(timeline, '') AS timeline, coalesce(events, 0) AS events, coalesce(ag.names, []) AS names, coalesce(wc.n, 0) AS work_count, coalesce([x FOR x IN ag.names IF regexp_full_match(x, '[\\x00-\\x7F]+')][1], name_en, primary_name) AS romanized_name FROM pp LEFT JOIN tl ON tl.owner = pp.id LEFT JOIN ag ON ag.person_id = pp.id LEFT JOIN wc ON wc.person_id = pp.id),
p AS (SELECT id, slug, coalesce(name_zh, primary_name) AS name, coalesce(name_ja, primary_name) AS original_name, romanized_name, CASE WHEN active THEN '活跃' WHEN NOT active THEN '引退' ELSE '资料待确认' END AS status,
  coalesce(debut, year(created_at)) AS debut_year, timeline, events, names, work_count, coalesce(nullif(upper(array_to_string([y[1] FOR y IN [x FOR x IN regexp_split_to_array(trim(romanized_name), '\\s+') IF x <> ''][1:2]], '')), ''), 'AV') AS initials,
  ['coral', 'sage', 'ink', 'gold'][position % 4 + 1] AS tone, array_to_string(names, '、') AS aliases, len(names) AS alias_count, coalesce(biography, '暂无公开简介。') AS biography, primary_name FROM p0)
"""
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _search(rows: str, values: str, query: str, allowed: int) -> str:
    """The SQL of a search of `rows` over a list of values. It folds what a query in Latin letters can meet: width, case, hyphens, blanks."""
    folded = f"trim(regexp_replace(regexp_replace(lower(translate(x, '{_FULL}', '{_HALF}')), '[‐-―ー]', '-', 'g'), '[\\s\\p{{Z}}\\x{{FEFF}}]+', ' ', 'g'), ' ')"
    return f"""v AS (SELECT id AS vid, unnest({values}) AS x, unnest(range(len({values}))) AS n FROM {rows}), f AS (SELECT vid, n, x, {folded} AS y FROM v),
s AS (SELECT vid, n, x AS value, CASE WHEN y = '{query}' THEN 'exact' WHEN starts_with(y, '{query}') THEN 'prefix' WHEN contains(y, '{query}') THEN 'contains' WHEN levenshtein(y, '{query}') <= {allowed} THEN 'fuzzy' END AS kind, levenshtein(y, '{query}') AS apart FROM f),
h AS (SELECT vid, n, value, kind, CASE kind WHEN 'exact' THEN 100 WHEN 'prefix' THEN 80 WHEN 'contains' THEN 60 ELSE 30 - apart END AS score FROM s WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vid ORDER BY CASE kind WHEN 'exact' THEN 100 WHEN 'prefix' THEN 80 WHEN 'contains' THEN 60 ELSE 30 - apart END DESC, n) = 1)
"""


_WORK_VALUES, _PERSON_VALUES = "list_concat([title, original_title, code, maker], members, [tags])", "list_concat([name, original_name, romanized_name], names)"
_FIRST = "(SELECT min(m) FROM (SELECT unnest(members) AS m FROM w))"
_WP = """SELECT DISTINCT ca.person_id, w.id AS work_id FROM ca JOIN w ON w.id = ca.work_id"""

QUERIES = {
    f.__name__: f
    for f in (
        catalog_works, catalog_people, published_scan, child_semi_scan, latest_release_per_work, works_without_release, ordered_cast_list, credit_count_per_person, related_works_by_person,
        related_works_by_name, cast_of_work_billing, cast_of_work_names, facet_years, facet_makers, facet_tags, facet_cast, facet_debut_years, filter_combo, filter_exclude, domain_checked_filter,
        status_filter, favorites_only, favorite_flag, completeness_works, completeness_people, works_newest_first, related_numeric_order, format_release_date, alias_valid_at, last_release_per_person, or_within_group,
        works_page_relevance, works_page_oldest, works_page_cast, works_page_count, people_page_relevance, people_page_debut, people_page_debut_oldest, home_search, timelines, makers, search_vectors, person_vectors,
        related_places_oldest, work_record, person_record, work_page_title, detail_medium, detail_confidence, page_slugs, status_three_valued,
    )
}
SQL = {
    "catalog_works": _BASE + "SELECT id, slug, code, title, original_title, release_date, release_year, maker, \"cast\", tone, runtime_minutes, tags, synopsis FROM w",
    "catalog_people": _BASE + "SELECT id, slug, name, original_name, romanized_name, status, debut_year, work_count, initials, tone, aliases, biography, timeline FROM p",
    "published_scan": "SELECT DISTINCT id, slug, title_original FROM works WHERE status = 'published'",
    "child_semi_scan": _BASE + "SELECT id, work_id, code FROM re WHERE work_id IN (SELECT id FROM pw)",
    "latest_release_per_work": _BASE + "SELECT work_id AS id, code, strftime(release_date, '%Y-%m-%d') AS release_date FROM lr",
    "works_without_release": _BASE + "SELECT id FROM pw WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.work_id = pw.id)",
    "ordered_cast_list": _BASE + "SELECT work_id AS id, names AS \"cast\" FROM cl",
    "credit_count_per_person": _BASE + "SELECT pp.id, coalesce(n, 0) AS work_count FROM pp LEFT JOIN wc ON wc.person_id = pp.id",
    "related_works_by_person": _BASE + _WP,
    "related_works_by_name": _BASE + "SELECT DISTINCT p.id AS person_id, w.id AS work_id FROM ca JOIN w ON w.id = ca.work_id JOIN p ON p.name = ca.primary_name",
    "cast_of_work_billing": _BASE + "SELECT work_id, person_id, row_number() OVER (PARTITION BY work_id ORDER BY o) - 1 AS place FROM (SELECT ca.work_id, ca.person_id, min(o) AS o FROM ca JOIN w ON w.id = ca.work_id GROUP BY 1, 2)",
    "cast_of_work_names": _BASE + "SELECT work_id, person_id, row_number() OVER (PARTITION BY work_id ORDER BY primary_name, person_id) - 1 AS place FROM (SELECT DISTINCT ca.work_id, ca.person_id, ca.primary_name FROM ca JOIN w ON w.id = ca.work_id)",
    "facet_years": _BASE + "SELECT DISTINCT release_year AS value FROM w",
    "facet_makers": _BASE + "SELECT DISTINCT maker AS value FROM w",
    "facet_tags": _BASE + "SELECT DISTINCT tags AS value FROM w",
    "facet_cast": _BASE + "SELECT DISTINCT ca.primary_name AS value FROM ca JOIN w ON w.id = ca.work_id",
    "facet_debut_years": _BASE + "SELECT DISTINCT debut_year AS value FROM p",
    "filter_combo": _BASE + "SELECT id, (length(synopsis) > 0)::INT + cast_size + 1 + 1 AS completeness FROM w WHERE release_year = 2020 AND tags = '数字发行'",
    "filter_exclude": _BASE + "SELECT id FROM w WHERE tags <> '数字发行'",
    "domain_checked_filter": _BASE + "SELECT id FROM w WHERE tags = '实体发行'",
    "status_filter": _BASE + "SELECT id, debut_year FROM p WHERE status = '引退'",
    "favorites_only": _BASE + "SELECT id FROM w WHERE id IN (SELECT work_id FROM re GROUP BY 1 HAVING count(*) > 1)",
    "favorite_flag": _BASE + "SELECT id, coalesce(id IN (SELECT work_id FROM re WHERE work_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1), false) AS is_favorite FROM w",
    "completeness_works": _BASE + "SELECT id, (length(synopsis) > 0)::INT + cast_size + 1 + 1 AS completeness FROM w",
    "completeness_people": _BASE + "SELECT id, (length(biography) > 0)::INT + alias_count + events AS completeness FROM p",
    "works_newest_first": _BASE + "SELECT id, CASE WHEN r < 10 THEN '0' ELSE '' END || r AS ordinal FROM (SELECT id, row_number() OVER (ORDER BY release_date DESC, original_title, id) AS r FROM w)",
    "related_numeric_order": _BASE + "SELECT id, array_to_string([CASE WHEN regexp_matches(x, '^\\d') THEN repeat('0', greatest(20 - length(x), 0)::INT) || x ELSE x END FOR x IN regexp_extract_all(lower(code), '\\d+|\\D+')], '') AS code_key FROM w",
    "format_release_date": _BASE + "SELECT id, strftime(release_date, '%Y.%m.%d') AS shown FROM re",
    "alias_valid_at": _BASE + "SELECT id, person_id, name FROM al WHERE (valid_from IS NULL OR valid_from <= DATE '2018-01-01') AND (valid_to IS NULL OR valid_to > DATE '2018-01-01')",
    "last_release_per_person": _BASE + "SELECT cr.person_id, strftime(max(release_date), '%Y-%m-%d') AS last_release FROM cr JOIN re ON re.work_id = cr.work_id GROUP BY 1",
    "or_within_group": _BASE + "SELECT id FROM w WHERE tags IN ('数字发行', '实体发行')",
    "works_page_relevance": _BASE + ", " + _search("w", _WORK_VALUES, "vol.2", 1) + "SELECT id, CAST(row_number() OVER (ORDER BY score DESC, (length(synopsis) > 0)::INT + cast_size DESC, release_date DESC, original_title, id) - 1 AS INT) AS place, kind, CAST(score AS INT) AS score, value FROM h JOIN w ON w.id = vid",
    "works_page_oldest": _BASE + f"SELECT id, CAST(row_number() OVER (ORDER BY release_date, original_title, id) - 1 AS INT) AS place FROM w WHERE maker = '发行方待确认' AND NOT list_contains(members, {_FIRST})",
    "works_page_cast": _BASE + f"SELECT id, CAST(row_number() OVER (ORDER BY release_date DESC, original_title, id) - 1 AS INT) AS place FROM w WHERE list_contains(members, {_FIRST})",
    "works_page_count": _BASE + "SELECT count(*) AS count FROM w WHERE tags = '数字发行'",
    "people_page_relevance": _BASE + ", " + _search("p", _PERSON_VALUES, "tsubaki", 1) + "SELECT id, (length(biography) > 0)::INT + alias_count + events AS completeness, kind, CAST(score AS INT) AS score, value FROM h JOIN p ON p.id = vid",
    "people_page_debut": _BASE + "SELECT id, CAST(row_number() OVER (ORDER BY debut_year DESC, primary_name, id) - 1 AS INT) AS place, debut_year FROM p WHERE status = '活跃'",
    "people_page_debut_oldest": _BASE + "SELECT id, CAST(row_number() OVER (ORDER BY debut_year, primary_name, id) - 1 AS INT) AS place FROM p WHERE debut_year = 2019 OR NOT EXISTS (SELECT 1 FROM p WHERE debut_year = 2019)",
    "home_search": _BASE + ", " + _search("p", "[name, original_name, romanized_name]", "maki", 1).replace(" h AS", " hp AS").replace("h AS (", "hp AS (", 1).replace("v AS (", "vp AS (", 1).replace("FROM v)", "FROM vp)").replace("f AS (", "fp AS (", 1).replace("FROM f)", "FROM fp)").replace("s AS (", "sp AS (", 1).replace("FROM s WHERE", "FROM sp WHERE") + ", " + _search("w", "list_concat([code, title, original_title, maker], members)", "maki", 1) + "SELECT 'person' AS kind, id, name AS label FROM hp JOIN p ON p.id = vid UNION ALL SELECT 'work', id, title FROM h JOIN w ON w.id = vid",
    "timelines": _BASE + "SELECT owner AS id, min(CASE WHEN type = 'debut' THEN year END) OVER (PARTITION BY owner) AS debut, CAST(row_number() OVER (PARTITION BY owner ORDER BY year, created_at, id, label, detail) - 1 AS INT) AS place, year, label, detail FROM et",
    "makers": _BASE + "SELECT id, maker FROM w",
    "search_vectors": _BASE + f"SELECT id, array_to_string({_WORK_VALUES}, '|') AS searched FROM w",
    "person_vectors": _BASE + f"SELECT id, array_to_string({_PERSON_VALUES}, '|') AS searched FROM p",
    "related_places_oldest": _BASE + f"SELECT person_id, work_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY release_date, original_title, w.id) - 1 AS INT) AS place FROM ({_WP}) x JOIN w ON w.id = x.work_id",
    "work_record": _BASE + "SELECT w.id, w.tone, (SELECT string_agg(person_id, ',' ORDER BY o) FROM (SELECT person_id, min(o) AS o FROM ca WHERE work_id = w.id GROUP BY 1)) AS people FROM w WHERE slug = (SELECT min(slug) FROM w) ORDER BY w.id LIMIT 1",
    "person_record": _BASE + f"SELECT p.id, p.tone, (SELECT string_agg(work_id, ',' ORDER BY work_id) FROM ({_WP}) x WHERE x.person_id = p.id) AS works FROM p WHERE slug = (SELECT min(slug) FROM p) ORDER BY p.id LIMIT 1",
    "work_page_title": _BASE + "(SELECT title FROM w WHERE slug = (SELECT min(slug) FROM w) ORDER BY id LIMIT 1) UNION ALL SELECT '作品不存在'",
    "detail_medium": _BASE + "SELECT id, CASE WHEN tags = '实体发行' THEN '实体' ELSE '数字' END AS medium FROM w",
    "detail_confidence": _BASE + "SELECT id, CASE WHEN status = '资料待确认' THEN '待审核' ELSE '已确认' END AS confidence FROM p",
    "page_slugs": _BASE + "SELECT DISTINCT slug FROM w WHERE slug IS NOT NULL",
    "status_three_valued": "SELECT DISTINCT id, CASE WHEN active THEN '活跃' WHEN NOT active THEN '引退' ELSE '资料待确认' END AS state, active FROM (SELECT DISTINCT id, active FROM people)",
}
