import pytest
from pyspark.sql import functions as F

from corvane.functions.text import numeric_key
from corvane.operators import catalog as c
from corvane.operators import directory as d
from corvane.operators.ranking import with_position
from corvane.sources.catalog_source import JdbcTables, MemoryTables, ParquetTables, open_tables, resolve_source
from corvane.sources.demo import DEMO_ROWS
from tests.conftest import rows


@pytest.fixture(scope="module")
def catalog(spark):
    return c.Catalog(open_tables(spark, "demo"))


def test_sources(spark):
    assert resolve_source("") == resolve_source("demo") == "demo" and resolve_source("postgres") == "postgres"
    with pytest.raises(ValueError):
        resolve_source("oracle")
    with pytest.raises(ValueError):
        ParquetTables(spark, "")
    with pytest.raises(ValueError):
        open_tables(spark, "postgres", url="")


def test_works(catalog):
    got = {r["id"]: r for r in catalog.works().collect()}
    assert set(got) == {"w1", "w2"}  # w3 has no release, w4 isn't published
    w1, w2 = got["w1"], got["w2"]
    assert (w1["code"], w1["title"], w1["release_date"], w1["maker"], w1["runtime_minutes"], w1["tags"]) == ("AB-001", "水之阶梯", "2020-01-05", "灯屋", 90, ["数字发行"])
    assert w1["cast"] == ["Nagi Kaede", "灯野硯", "灯野硯"] and w1["cast_ids"] == ["p2", "p1", "p1"]
    assert (w2["release_date"], w2["release_year"], w2["maker"], w2["runtime_minutes"], w2["tags"], w2["cast"], w2["synopsis"]) == ("1900-01-01", 1900, c.NO_MAKER, 0, [c.NO_MEDIUM], [], c.NO_SYNOPSIS)
    assert (w2["tone"], w1["tone"]) == ("moon", "afternoon")  # positions 0 and 1 of all published works


def test_people(catalog):
    got = {r["id"]: r for r in catalog.people().collect()}
    assert set(got) == {"p1", "p2", "p3"}
    p1, p2, p3 = got["p1"], got["p2"], got["p3"]
    assert (p1["name"], p1["romanized_name"], p1["status"], p1["debut_year"], p1["work_count"], p1["initials"]) == ("灯野砚", "Suzu Tomono", "活跃", 2012, 3, "ST")
    assert [tuple(x) for x in p1["timeline"]] == [(2012, "出道", "初舞台"), (2015, "职业记录", c.NO_EVENT_DETAIL)]
    assert (p2["status"], p2["debut_year"], p2["work_count"], [tuple(x) for x in p2["timeline"]]) == ("引退", 2021, 1, [(2021, "引退", c.NO_EVENT_DETAIL)])
    assert (p3["status"], p3["aliases"], p3["romanized_name"], p3["work_count"]) == ("资料待确认", [""], "霧島波", 0)


def test_lookups(catalog):
    assert catalog.find_work("work-1").count() == 1 and catalog.find_work("nothing").count() == 0
    assert catalog.find_person("person-4").count() == 0
    people, works = catalog.people(), catalog.works()
    assert rows(c.works_of_people(people, works)) == [("p1", "w1"), ("p2", "w1")]
    assert rows(c.works_of_people(people, works, "name")) == [("p2", "w1")]  # p1's shown name isn't the primary one
    assert rows(c.people_of_works(works, people)) == [("w1", "p1", 1), ("w1", "p2", 0)]
    assert rows(c.people_of_works(works, people, "name")) == [("w1", "p1", 1), ("w1", "p2", 0)]


def test_directory(catalog, spark):
    works, people = catalog.works().cache(), catalog.people().cache()
    ids = lambda f, fav=None: [r["id"] for r in d.works_page(works, f, fav).collect()]
    assert ids(d.WorksFilter()) == ["w1", "w2"]  # completeness
    assert ids(d.WorksFilter(sort="release-oldest")) == ["w2", "w1"] and ids(d.WorksFilter(sort="code")) == ["w1", "w2"]
    assert ids(d.WorksFilter(year="2020")) == ["w1"] and ids(d.WorksFilter(year="1777")) == ["w1", "w2"]
    assert ids(d.WorksFilter(exclude_cast="Nagi Kaede")) == ["w2"] and ids(d.WorksFilter(cast="Nagi Kaede")) == ["w1"]
    assert ids(d.WorksFilter(q="amber")) == ["w2"] and ids(d.WorksFilter(q="nothing at all")) == []
    liked = spark.createDataFrame([("w2",)], "entity_id string")
    assert ids(d.WorksFilter(favorites_only=True), liked) == ["w2"]
    assert rows(d.with_favorite(works, liked).select("id", "is_favorite")) == [("w1", False), ("w2", True)]
    names = lambda f: [r["id"] for r in d.people_page(people, f).collect()]
    assert names(d.PeopleFilter(status="引退")) == ["p2"] and names(d.PeopleFilter(debut="2012", sort="debut-oldest")) == ["p1"]
    assert names(d.PeopleFilter(q="トモノ スズリ")) == ["p1"]
    assert [r["value"] for r in d.facet(works, "release_year", descending=True).collect()] == [2020, 1900]
    home = d.home_search(people, works, "suzu").collect()
    assert [(r["kind"], r["id"]) for r in home] == [("person", "p1")]  # romanized name, not aliases


def test_records(catalog):
    w = catalog.work_record("work-1").first()
    assert w["id"] == "w1" and w["tone"] == "afternoon" and [p["id"] for p in w["people"]] == ["p2", "p1"]
    p = catalog.person_record("person-1").first()
    assert p["id"] == "p1" and [x["id"] for x in p["works"]] == ["w1"] and catalog.person_record("person-3").first()["works"] is None
    assert catalog.work_record("nothing").count() == 0
    assert [c.page_title(catalog.find_work(s), "title", "none").first()[0] for s in ("work-1", "nothing")] == ["水之阶梯", "none"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_what_they_need(spark, tmp_path):
    folder = str(tmp_path)
    demo = open_tables(spark, "demo")
    for name in ("people", "person_aliases", "career_events", "organizations", "works", "releases", "credits"):
        demo[name].write.parquet(f"{folder}/{name}.parquet")
    tables = ParquetTables(spark, folder)
    years = _plan(d.facet(c.assemble_works(tables), "release_year", descending=True))
    assert "RDD" not in years and "synopsis" not in years and "biography" not in years
    found = _plan(c.Catalog(tables).find_work("work-1"))
    assert "RDD" not in found and "EqualTo(slug,work-1)" in found
    assert [r["id"] for r in c.Catalog(tables).find_work("work-1").collect()] == ["w1"]


def test_exact_repeats_count_once(spark, tmp_path):
    folder = str(tmp_path)
    demo = open_tables(spark, "demo")
    for name in ("people", "works", "releases", "credits"):
        demo[name].unionByName(demo[name]).write.parquet(f"{folder}/{name}.parquet")
    w = {r["id"]: r for r in c.assemble_works(ParquetTables(spark, folder)).collect()}
    assert w["w1"]["cast_ids"] == ["p2", "p1", "p1"] and len(w) == 2


def test_one_person_in_a_third_of_the_credits(spark):
    many = [{"work_id": f"w{i % 50}", "person_id": "hot" if i % 3 == 0 else f"p{i}", "credit_type": "performer", "billing_order": i} for i in range(900)]
    people = spark.createDataFrame([("hot", "H"), *((f"p{i}", f"P{i}") for i in range(900))], "id string, primary_name string")
    credits = MemoryTables(spark, {"credits": many}).rows("credits", "work_id", "person_id", "credit_type", "billing_order")
    got = {r["id"]: r["cast_ids"] for r in c.casts(credits, people).collect()}
    assert sum(map(len, got.values())) == 900 and sum(x.count("hot") for x in got.values()) == 300


def test_texts_of_details(spark):
    df = spark.createDataFrame([("活跃", [c.MEDIA["physical"]]), ("资料待确认", [c.NO_MEDIUM])], "status string, tags array<string>")
    assert rows(df.select(c.detail_confidence(F.col("status")), c.detail_medium(F.col("tags")), c.status_value(F.col("status")))) == [("已确认", "实体", True), ("待审核", "数字", None)]


def test_relational_reads_can_be_split(spark):
    t = JdbcTables(spark, "jdbc:x", ranges={"works": ("created_at", "2020-01-01", "2024-01-01", 16)})
    assert t.read_options("works")["numPartitions"] == "16" and "numPartitions" not in t.read_options("people")


def test_filter_state_round_trip():
    f = d.WorksFilter(q="x", tag="t")
    assert f.to_params() == {"q": "x", "tag": "t"} and d.WorksFilter.from_params(f.to_params() | {"other": "1"}) == f


def test_numeric_order_of_codes(spark):
    df = spark.createDataFrame([(i, x, "2020-01-01", x) for i, x in enumerate(["DEMO-2", "demo-10", "demo-1"])], "position long, code string, release_date string, title string").selectExpr("*", "title original_title", "string(position) id")
    assert [r[0] for r in spark.createDataFrame([("É2",), ("e10",), ("e1",), ("がé",), ("か",)], "v string").select(numeric_key(F.col("v"))).collect()] == ["e" + "2".zfill(20), "e" + "10".zfill(20), "e" + "1".zfill(20), "がe", "か"]
    assert [r["code"] for r in df.orderBy(*d.related_order("code")).collect()] == ["demo-1", "DEMO-2", "demo-10"]


def test_empty_catalog(spark):
    empty = MemoryTables(spark, {})
    assert c.assemble_works(empty).count() == 0 and c.assemble_people(empty).count() == 0


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert with_position(df, "p", F.col("x")).where("p <> x").count() == 0


def test_demo_rows_are_published_people():
    assert sum(p["status"] == "published" for p in DEMO_ROWS["people"]) == 3
