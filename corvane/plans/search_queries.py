"""Queries on search, text functions, libraries and loading, with their SQL.

Orders stand for works, line items for credits, customers for persons, parts for what is searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import search as s
from corvane.functions import text as t
from corvane.operators import library as lib
from corvane.operators import load
from corvane.operators.ranking import with_position
from corvane.operators.catalog import assemble_works
from corvane.sources.catalog_source import ParquetTables
from corvane.sources.schema import duplicate_keys, orphans, outside_domain
from corvane.sources.tables import table


def _part_values() -> Column:
    return F.transform(F.array("p_name", "p_brand", "p_type"), F.lower)


def _searched(spark: SparkSession, folder: str, query: str) -> DataFrame:
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return s.search(parts, query, _part_values(), is_normalized=True)


def search_tiers(spark, folder):
    """Exact, prefix and contained hits."""
    return _searched(spark, folder, "Small").select("p_partkey", F.col("match.kind").alias("kind"), F.col("match.score").alias("score"))


def search_fuzzy(spark, folder):
    """Hits with typing errors."""
    return _searched(spark, folder, "smal rimg").select("p_partkey", F.col("match.kind").alias("kind"), F.col("match.score").alias("score"))


def search_best_hit(spark, folder):
    """The best value of each row, with its place and what is shown of it."""
    hits = _searched(spark, folder, "brand#1")
    return hits.select("p_partkey", F.col("match.index").alias("place"), F.col("match.kind").alias("kind"), s.match_label("brand#1", F.array("p_name", "p_brand", "p_type")).alias("label"))


def search_boolean(spark, folder):
    """Rows that the query finds at all."""
    return table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type").where(s.matches("blue", _part_values())).select("p_partkey")


def normalize_codes(spark, folder):
    """Normalized codes of all releases, whatever they are written in."""
    return table(spark, folder, "releases", "id", "code").distinct().select("id", t.normalized(F.col("code")).alias("folded"))


def normalize_titles(spark, folder):
    """Normalized titles in all scripts."""
    return table(spark, folder, "works", "id", "title_original").distinct().select("id", t.normalized(F.col("title_original")).alias("folded"))


def initials(spark, folder):
    return table(spark, folder, "part", "p_partkey", "p_name").select("p_partkey", t.initials(F.col("p_name")).alias("initials"))


def tag_split(spark, folder):
    """Typed lists divided into tags: the words of the types with commas of either width between them."""
    typed = F.concat_ws(", ", F.col("p_name"), F.lit(""), F.concat(F.col("p_brand"), F.lit("，"), F.col("p_type")))
    return table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", F.array_join(t.split_tags(typed), "|").alias("tags"))


def numeric_names(spark, folder):
    return table(spark, folder, "customer", "c_custkey", "c_name").select("c_custkey", t.numeric_key(F.col("c_name")).alias("name_key"))


def tone_rotation(spark, folder):
    """Tones that turn with the position in the order by name."""
    parts = with_position(table(spark, folder, "part", "p_partkey", "p_name"), "position", F.col("p_name"), F.col("p_partkey"))
    tones = F.array(*[F.lit(x) for x in ("coral", "sage", "ink", "gold")])
    return parts.select("p_partkey", F.element_at(tones, (F.col("position") % 4 + 1).cast("int")).alias("tone"))


def _owned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A library made of the tables: customers' favourites, and notes on suppliers and some customers."""
    favorites = table(spark, folder, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 5000").select(F.lit("person").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_custkey").cast("int").alias("place"))
    people = table(spark, folder, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'MACHINERY'").select(F.lit("person").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id"), F.array("c_mktsegment").alias("tags"), F.lit("seen").alias("note"), F.col("c_custkey").cast("int").alias("noted"))
    works = table(spark, folder, "supplier", "s_suppkey", "s_name").select(F.lit("work").alias("entity_type"), F.col("s_suppkey").cast("string").alias("entity_id"), F.array("s_name").alias("tags"), F.lit("").alias("note"), (-F.col("s_suppkey")).cast("int").alias("noted"))
    return favorites, people.unionByName(works)


def _flat_library(df: DataFrame) -> DataFrame:
    return df.select("entity_type", "entity_id", "favorite", "place", F.array_join("tags", ",").alias("tags"), "note", "noted")


def library_export(spark, folder):
    """One row for each entity that is a favourite or has a note, at its place in the exported document."""
    owned = lib.join_favorites_and_notes(*_owned(spark, folder))
    at = with_position(owned, "at", *lib.export_order(owned))
    return at.select("entity_type", "entity_id", "favorite", F.array_join("tags", ",").alias("tags"), "note", F.col("at").cast("int").alias("at"))


def _annotations(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where("o_custkey % 3 = 0")
    return o.select(F.lit("person").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), F.array("o_orderpriority").alias("tags"), F.lit("new").alias("note"), F.col("o_orderkey").cast("int").alias("noted"))


def library_annotate(spark, folder):
    """The library after notes on some customers were entered or replaced."""
    return _flat_library(lib.annotate(lib.join_favorites_and_notes(*_owned(spark, folder)), _annotations(spark, folder)))


def library_entity_notes(spark, folder):
    """Each customer with what the library says on them."""
    c = table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").cast("string").alias("id"))
    noted = lib.with_notes(c, lib.join_favorites_and_notes(*_owned(spark, folder)), "person")
    return noted.select("id", F.array_join("tags_noted", ",").alias("tags"), "note")


def library_stored_rows(spark, folder):
    """Stored documents of many libraries read leniently: every seventh is corrupt, every fifth of another version."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey")
    text = F.concat(F.lit('{"version": '), F.when(F.col("o_custkey") % 5 == 0, "2").otherwise("1"), F.lit(', "favorites": {"people": ["'), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), '", "'), F.lit('"], "works": [3, "w", "w"]}, "annotations": {"work:w": {"tags": ["t"]}}'), F.when(F.col("o_custkey") % 7 == 0, "").otherwise("}"))
    documents = o.groupBy("o_custkey").agg(text.alias("text"))
    return lib.stored_rows(documents, "o_custkey", "text").select("owner", "entity_type", "entity_id", "favorite", "place", F.array_join("tags", ",").alias("tags"), "note", "noted")


def _imported(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return o.select(F.lit("person").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), (F.col("o_orderstatus") == "F").alias("favorite"), F.col("o_orderkey").cast("int").alias("place"), F.array("o_orderstatus").alias("tags"), F.lit("imported").alias("note"), F.col("o_orderkey").cast("int").alias("noted"))


def library_merge(spark, folder):
    """An import merged into the library: the last item of each entity wins, others stay."""
    return _flat_library(lib.merge(lib.join_favorites_and_notes(*_owned(spark, folder)), _imported(spark, folder)))


def library_preview(spark, folder):
    """How many imported items the catalog knows and lacks."""
    known = table(spark, folder, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.lit("person").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id"))
    return lib.preview(_imported(spark, folder), known)


def library_toggle(spark, folder):
    """Favourites after all customers with an urgent order were toggled."""
    favorites, _ = _owned(spark, folder)
    urgent = table(spark, folder, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    toggled = urgent.select(F.lit("person").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_custkey").cast("int").alias("place"))
    return lib.toggle(favorites, toggled)


def upsert_merge(spark, folder):
    """Deliveries merged into suppliers: known ones take the balance only."""
    target = table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    incoming = table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal").where("c_nationkey < 5").toDF("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return load.upsert(target, incoming, "s_suppkey", ["s_acctbal"])


def replace_children(spark, folder):
    """Lines of open orders replaced by one line each."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    new = table(spark, folder, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("bigint").alias("l_partkey"), F.lit(1.0).alias("l_quantity"))
    return load.replace_children(lines, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


def cascade_delete(spark, folder):
    """Credits left after all hidden works were deleted."""
    works = table(spark, folder, "works", "id", "status").distinct()
    return load.cascade_delete(table(spark, folder, "credits", "work_id", "person_id", "credit_type").distinct(), "work_id", works.where("status = 'hidden'"))


def unnest_aliases(spark, folder):
    """Aliases with the language that their letters tell."""
    a = table(spark, folder, "person_aliases", "id", "name").distinct().select("id", F.array("name").alias("aliases"))
    return load.alias_rows(a).select(F.col("person_id").alias("id"), "name", "language")


def sequence_ids(spark, folder):
    """Made-up ids by number."""
    return table(spark, folder, "supplier", "s_suppkey").select("s_suppkey", load.sequence_id("a001", F.col("s_suppkey") + 1).alias("id"))


def cast_rows(spark, folder):
    """The casts of the view of works as rows, by name."""
    t = ParquetTables(spark, folder)
    works, people = assemble_works(t), t.rows("people", "id", F.col("primary_name").alias("name"), where="status = 'published'")
    return load.cast_rows(works, people)


def event_rows(spark, folder):
    """Timelines of snapshots as rows of career events."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("出道", "引退", "复出", "职业记录")]), (F.col("snapshot_id") % 4 + 1).cast("int"))
    entry = F.struct(F.year("snapshot_date").alias("year"), label.alias("label"), F.col("snapshot_id").cast("string").alias("detail"))
    nested = table(spark, folder, "people_snapshots", "snapshot_id", "person_id", "snapshot_date").distinct().groupBy(F.col("person_id").alias("id")).agg(F.collect_list(entry).alias("timeline"))
    return load.event_rows(nested).withColumn("event_date", F.col("event_date").cast("string"))


def upsert_works(spark, folder):
    """Works in review delivered again with other titles, and new ones: known works take title and synopsis only."""
    rows = table(spark, folder, "works", "id", "slug", "title_original", "synopsis", "status").distinct()
    again = rows.where("status = 'review'").select("id", "slug", F.upper("title_original").alias("title_original"), F.lit("again").alias("synopsis"), F.lit("published").alias("status"))
    new = rows.where("status = 'hidden'").select(F.concat(F.lit("new-"), "id").alias("id"), "slug", "title_original", "synopsis", F.lit("draft").alias("status"))
    return load.upsert(rows, again.unionByName(new), "id", ["title_original", "synopsis"])


def upsert_organizations(spark, folder):
    """Organizations by slug, here nations, that a delivery of suppliers' nations renames or adds to."""
    target = table(spark, folder, "nation", "n_nationkey", "n_name").where("n_nationkey < 15").select(F.col("n_name").alias("slug"), F.col("n_nationkey").alias("id"), F.lit("maker").alias("type"), F.lit("old").alias("name"))
    incoming = table(spark, folder, "nation", "n_nationkey", "n_name").where("n_nationkey > 9").select(F.col("n_name").alias("slug"), (F.col("n_nationkey") + 100).alias("id"), F.lit("label").alias("type"), F.lower("n_name").alias("name"))
    return load.upsert(target, incoming, "slug", ["type", "name"])


def releases_by_code(spark, folder):
    """Releases replaced by code: those of a delivery of longer runtimes stand for all of their code."""
    rows = table(spark, folder, "releases", "id", "code", "runtime_minutes").distinct().where("code is not null")
    new = rows.where("runtime_minutes > 150").select(F.concat(F.lit("r-"), "id").alias("id"), "code", (F.col("runtime_minutes") + 1).alias("runtime_minutes"))
    return load.replace_children(rows, new, "code")


def resolve_slugs(spark, folder):
    """Delivered works, known by slug only, with the ids of the persisted ones."""
    rows = table(spark, folder, "works", "id", "slug", "status").distinct()
    delivered = rows.where("status <> 'draft'").select(F.col("slug"), F.concat(F.lit("delivered "), "slug").alias("note")).distinct()
    return load.resolve_slugs(delivered, rows.where("status = 'published'").select("id", "slug"))


def validate_fk(spark, folder):
    """Tags whose parent doesn't exist, ids being compared as written."""
    tags = table(spark, folder, "tags", "id", "parent_id").distinct()
    return orphans(tags, "parent_id", tags)


def validate_unique(spark, folder):
    """Slugs that several people bear."""
    return duplicate_keys(table(spark, folder, "people", "id", "slug").distinct(), "slug")


def validate_enum(spark, folder):
    """Media outside the domain."""
    return outside_domain(table(spark, folder, "releases", "id", "medium").distinct(), "medium", ["digital", "physical"])


def relation_edges(spark, folder):
    """The edges of the graph of persons and works."""
    return table(spark, folder, "credits", "person_id", "work_id").where("person_id is not null and work_id is not null").distinct()


_HIT = """p AS (SELECT p_partkey, v.value, v.n - 1 AS place FROM part, (SELECT unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS value, unnest([1, 2, 3]) AS n) v),
k AS (SELECT p_partkey, place, value, CASE WHEN value = q THEN 'exact' WHEN starts_with(value, q) THEN 'prefix' WHEN contains(value, q) THEN 'contains' WHEN length(q) >= 4 AND levenshtein(value, q) <= greatest(1, length(q) // 4) THEN 'fuzzy' END AS kind, levenshtein(value, q) AS apart FROM p, q),
h AS (SELECT *, CASE kind WHEN 'exact' THEN 100 WHEN 'prefix' THEN 80 WHEN 'contains' THEN 60 ELSE 30 - apart END AS score FROM k WHERE kind IS NOT NULL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, place) = 1)
"""


def _hit(query: str) -> str:
    return f"WITH q AS (SELECT '{query}' AS q), {_HIT}"


_LIB = """WITH f AS (SELECT 'person' AS entity_type, CAST(c_custkey AS VARCHAR) AS entity_id, CAST(c_custkey AS INT) AS place FROM customer WHERE c_acctbal > 5000),
n AS (SELECT 'person' AS entity_type, CAST(c_custkey AS VARCHAR) AS entity_id, c_mktsegment AS tags, 'seen' AS note, CAST(c_custkey AS INT) AS noted FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION ALL SELECT 'work', CAST(s_suppkey AS VARCHAR), s_name, '', CAST(-s_suppkey AS INT) FROM supplier),
l AS (SELECT coalesce(f.entity_type, n.entity_type) AS entity_type, coalesce(f.entity_id, n.entity_id) AS entity_id, f.entity_id IS NOT NULL AS favorite, place, coalesce(tags, '') AS tags, coalesce(note, '') AS note, noted
  FROM f FULL JOIN n ON f.entity_type = n.entity_type AND f.entity_id = n.entity_id),
i AS (SELECT 'person' AS entity_type, CAST(o_custkey AS VARCHAR) AS entity_id, o_orderstatus = 'F' AS favorite, CAST(o_orderkey AS INT) AS place, o_orderstatus AS tags, 'imported' AS note, CAST(o_orderkey AS INT) AS noted FROM orders),
x AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY place DESC) = 1)
"""
QUERIES = {
    f.__name__: f
    for f in (
        search_tiers, search_fuzzy, search_best_hit, search_boolean, normalize_codes, normalize_titles, initials, tag_split, numeric_names, tone_rotation, 
        library_export, library_merge, library_preview, library_toggle, upsert_merge, replace_children,
        cascade_delete, unnest_aliases, sequence_ids, library_annotate, library_entity_notes, library_stored_rows, cast_rows, event_rows, upsert_works, upsert_organizations, releases_by_code, resolve_slugs, validate_fk, validate_unique, validate_enum, relation_edges,
    )
}
SQL = {
    "search_tiers": _hit("small") + "SELECT p_partkey, kind, score FROM b",
    "search_fuzzy": _hit("smal rimg") + "SELECT p_partkey, kind, score FROM b",
    "search_best_hit": _hit("brand#1") + "SELECT b.p_partkey, place, kind, CASE place WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS label FROM b JOIN part USING (p_partkey)",
    "search_boolean": _hit("blue") + "SELECT p_partkey FROM b",
    "initials": "SELECT p_partkey, upper(array_to_string([y[1] FOR y IN [x FOR x IN string_split(trim(p_name), ' ') IF x <> ''][1:2]], '')) AS initials FROM part",
    "tag_split": "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS tags FROM part",
    "numeric_names": "SELECT c_custkey, array_to_string([CASE WHEN regexp_matches(x, '^\\d') THEN repeat('0', greatest(20 - length(x), 0)::INT) || x ELSE x END FOR x IN regexp_extract_all(lower(c_name), '\\d+|\\D+')], '') AS name_key FROM customer",
    "tone_rotation": "SELECT p_partkey, ['coral', 'sage', 'ink', 'gold'][(row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 4 + 1] AS tone FROM part",
    "library_export": _LIB + "SELECT entity_type, entity_id, favorite, tags, note, CAST(row_number() OVER (ORDER BY noted IS NULL, noted, entity_type, place, entity_id) - 1 AS INT) AS at FROM l",
    "library_merge": _LIB + "SELECT * FROM l WHERE (entity_type, entity_id) NOT IN (SELECT (entity_type, entity_id) FROM x) UNION ALL SELECT entity_type, entity_id, x.favorite, CASE WHEN x.favorite THEN CAST(x.place + (SELECT coalesce(max(place), -1) FROM l) + 1 AS INT) END, x.tags, x.note, coalesce(l.noted, CAST(x.noted + (SELECT coalesce(max(noted), -1) FROM l) + 1 AS INT)) FROM x LEFT JOIN l USING (entity_type, entity_id)",
    "library_preview": _LIB + "SELECT count(*) FILTER (c_custkey IS NOT NULL) AS known, count(*) FILTER (c_custkey IS NULL) AS missing FROM i LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON CAST(c_custkey AS VARCHAR) = i.entity_id",
    "library_toggle": _LIB + ", u AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS entity_id, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT * FROM f WHERE entity_id NOT IN (SELECT entity_id FROM u) UNION ALL SELECT 'person', entity_id, CAST((SELECT coalesce(max(place), -1) FROM f) + 1 + o_custkey AS INT) FROM u WHERE entity_id NOT IN (SELECT entity_id FROM f)",
    "upsert_merge": "WITH i AS (SELECT * FROM customer WHERE c_nationkey < 5) SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS s_name, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS s_nationkey, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE c_acctbal END AS s_acctbal FROM supplier FULL JOIN i ON s_suppkey = c_custkey",
    "replace_children": "SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 1.0 FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "cascade_delete": "SELECT DISTINCT work_id, person_id, credit_type FROM credits WHERE work_id NOT IN (SELECT id FROM works WHERE status = 'hidden')",
    "unnest_aliases": "SELECT id, name, CASE WHEN regexp_full_match(name, '[\\x00-\\x7F]+') THEN 'en' ELSE 'ja' END AS language FROM (SELECT DISTINCT id, name FROM person_aliases)",
    "sequence_ids": "SELECT s_suppkey, '00000000-0000-4000-a001-' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 12, '0') AS id FROM supplier",
    "library_annotate": _LIB + ", a AS (SELECT 'person' AS entity_type, CAST(o_custkey AS VARCHAR) AS entity_id, o_orderpriority AS tags, CAST(o_orderkey AS INT) AS noted FROM orders WHERE o_custkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT entity_type, entity_id, coalesce(favorite, false) AS favorite, place, coalesce(a.tags, l.tags) AS tags, CASE WHEN a.noted IS NOT NULL THEN 'new' ELSE note END AS note, coalesce(l.noted, CAST(a.noted + (SELECT coalesce(max(noted), -1) FROM l) + 1 AS INT)) AS noted FROM l FULL JOIN a USING (entity_type, entity_id)",
    "library_entity_notes": _LIB + "SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(tags, '') AS tags, coalesce(note, '') AS note FROM customer LEFT JOIN l ON entity_type = 'person' AND entity_id = CAST(c_custkey AS VARCHAR)",
    "library_stored_rows": "WITH c AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 7 <> 0) SELECT CAST(o_custkey AS VARCHAR) AS owner, 'person' AS entity_type, CAST(o_orderkey AS VARCHAR) AS entity_id, true AS favorite, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS place, '' AS tags, '' AS note, CAST(NULL AS INT) AS noted FROM c UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'work', 'w', true, 0, 't', '', 0 FROM c",
    "cast_rows": "WITH pw AS (SELECT DISTINCT id FROM works WHERE status = 'published' AND id IN (SELECT work_id FROM releases)), pp AS (SELECT DISTINCT id, primary_name FROM people WHERE status = 'published'), cr AS (SELECT DISTINCT * FROM credits), ca AS (SELECT work_id, primary_name, CAST(row_number() OVER (PARTITION BY work_id ORDER BY coalesce(billing_order, 999), credit_type NULLS FIRST, pp.id) AS INT) AS billing_order FROM cr JOIN pp ON pp.id = cr.person_id WHERE work_id IN (SELECT id FROM pw)) SELECT work_id, person_id, billing_order FROM ca JOIN (SELECT primary_name, min(id) AS person_id FROM pp GROUP BY 1) USING (primary_name)",
    "event_rows": "SELECT person_id, ['debut', 'retirement', 'comeback', 'other'][snapshot_id % 4 + 1] AS type, strftime(make_date(year(snapshot_date)::INT, 1, 1), '%Y-%m-%d') AS event_date, 'year' AS date_precision, CAST(snapshot_id AS VARCHAR) AS note FROM (SELECT DISTINCT snapshot_id, person_id, snapshot_date FROM people_snapshots)",
    "upsert_works": "WITH r AS (SELECT DISTINCT id, slug, title_original, synopsis, status FROM works) SELECT id, slug, CASE status WHEN 'review' THEN upper(title_original) ELSE title_original END AS title_original, CASE status WHEN 'review' THEN 'again' ELSE synopsis END AS synopsis, status FROM r UNION ALL SELECT 'new-' || id, slug, title_original, synopsis, 'draft' FROM r WHERE status = 'hidden'",
    "upsert_organizations": "SELECT n_name AS slug, CASE WHEN n_nationkey < 15 THEN n_nationkey ELSE n_nationkey + 100 END AS id, CASE WHEN n_nationkey > 9 THEN 'label' ELSE 'maker' END AS type, CASE WHEN n_nationkey > 9 THEN lower(n_name) ELSE 'old' END AS name FROM nation",
    "releases_by_code": "WITH r AS (SELECT DISTINCT id, code, runtime_minutes FROM releases WHERE code IS NOT NULL) SELECT * FROM r WHERE code NOT IN (SELECT code FROM r WHERE runtime_minutes > 150) UNION ALL SELECT 'r-' || id, code, runtime_minutes + 1 FROM r WHERE runtime_minutes > 150",
    "resolve_slugs": "SELECT slug, note, id FROM (SELECT DISTINCT slug, 'delivered ' || slug AS note FROM works WHERE status <> 'draft') JOIN (SELECT slug, min(id) AS id FROM works WHERE status = 'published' AND slug IS NOT NULL GROUP BY 1) USING (slug)",
    "validate_fk": "SELECT DISTINCT id, parent_id FROM tags t WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tags u WHERE u.id = t.parent_id)",
    "validate_unique": "SELECT slug, count(*) AS rows FROM (SELECT DISTINCT id, slug FROM people) WHERE slug IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "validate_enum": "SELECT DISTINCT id, medium FROM releases WHERE medium NOT IN ('digital', 'physical')",
    "relation_edges": "SELECT DISTINCT person_id, work_id FROM credits WHERE person_id IS NOT NULL AND work_id IS NOT NULL",
}
