import pytest
from pyspark.sql import functions as F

from corvane.operators import load
from corvane.sources.schema import ENUMS, TABLES, duplicate_keys, orphans, outside_domain, schema
from corvane.streaming.observations import observation_stream
from tests.conftest import rows


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "slug string, name string, status int")
    i = spark.createDataFrame([("b", "new", 5), ("c", "C", 6)], "slug string, name string, status int")
    once = load.upsert(t, i, "slug", ["status"])
    assert rows(once) == [("a", "A", 1), ("b", "B", 5), ("c", "C", 6)]
    assert rows(load.upsert(once, i, "slug", ["status"])) == rows(once)


def test_children(spark):
    c = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "parent string, n int")
    i = spark.createDataFrame([("p", 9)], "parent string, n int")
    assert rows(load.replace_children(c, i, "parent")) == [("p", 9), ("q", 3)]
    assert rows(load.replace_children(c, i, "parent", spark.createDataFrame([("q",)], "parent string"))) == [("p", 9)]
    assert rows(load.cascade_delete(c, "parent", spark.createDataFrame([("p",)], "id string"))) == [("q", 3)]


def test_nested_to_rows(spark):
    w = spark.createDataFrame([("w", ["A", "nobody", "B"])], "id string, cast array<string>")
    p = spark.createDataFrame([("1", "A"), ("2", "B"), ("0", "B")], "id string, name string")
    assert rows(load.cast_rows(w, p)) == [("w", "0", 3), ("w", "1", 1)]
    v = spark.createDataFrame([("1", ["x", "え"], [(2012, "出道", "d"), (2013, "?", "e")])], "id string, aliases array<string>, timeline array<struct<year:int,label:string,detail:string>>")
    assert rows(load.alias_rows(v)) == [("1", "x", "en"), ("1", "え", "ja")]
    assert [(r["type"], str(r["event_date"])) for r in load.event_rows(v).collect()] == [("debut", "2012-01-01"), ("other", "2013-01-01")]
    assert spark.range(1).select(load.sequence_id("a001", F.lit(7))).first()[0] == "00000000-0000-4000-a001-000000000007"


def test_write_all_exchanges_folders(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    for n in (3, 5):
        load.write_all(spark, {"t": spark.range(n)}, folder)
        assert spark.read.parquet(f"{folder}/t.parquet").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["catalog"]


class _Failing:
    """A file system of which chosen renames return false or raise."""

    def __init__(self, fs, fail):
        self.fs, self.fail, self.renames = fs, fail, 0

    def rename(self, a, b):
        self.renames += 1
        how = self.fail.get(self.renames)
        if how == "raise":
            raise OSError("rename")
        return False if how == "false" else self.fs.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.fs, name)


@pytest.mark.parametrize("how", ["false", "raise"])
@pytest.mark.parametrize("step", [1, 2])
def test_write_all_keeps_the_old_tables(spark, tmp_path, how, step):
    folder = str(tmp_path / "catalog")
    load.write_all(spark, {"t": spark.range(3)}, folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    with pytest.raises(OSError):
        load.write_all(spark, {"t": spark.range(5)}, folder, _Failing(fs, {step: how}))
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["catalog"]


def test_write_all_deletes_nothing_if_nothing_can_be_moved(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    load.write_all(spark, {"t": spark.range(3)}, folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    with pytest.raises(OSError, match="the old tables are in"):
        load.write_all(spark, {"t": spark.range(5)}, folder, _Failing(fs, {2: "false", 3: "raise"}))
    assert sorted(spark.read.parquet(f"{p}/t.parquet").count() for p in tmp_path.iterdir()) == [3, 5]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    load.write_all(spark, {"t": spark.range(3)}, folder)
    with pytest.raises(Exception):
        load.write_all(spark, {"t": spark.range(5), "u": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, folder)
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["catalog"]


def test_slugs_resolve_to_ids(spark):
    persisted = spark.createDataFrame([("1", "a"), ("0", "a"), ("2", None)], "id string, slug string")
    assert rows(load.resolve_slugs(spark.createDataFrame([("a", 7), ("b", 8), (None, 9)], "slug string, n int"), persisted)) == [("a", 7, "0")]


def test_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "z"), (None, "x"), (None, "x")], "k string, v string")
    assert rows(duplicate_keys(df, "k")) == [("a", 2)]
    assert orphans(df, "k", spark.createDataFrame([("a",)], "id string")).count() == 1
    assert rows(outside_domain(df, "v", ["x"])) == [("b", "z")]
    assert all(len(schema(t)) for t in TABLES) and len(TABLES) == 16 and ENUMS["source_role"][0] == "authoritative"


def test_stream_of_observations(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    row = {f.name: None for f in schema("observations").fields}
    import datetime

    base = row | {"id": "1", "content_hash": "h", "observed_at": datetime.datetime(2024, 1, 1)}
    spark.createDataFrame([tuple(base.values()), tuple(base.values()), tuple((base | {"id": "2"}).values())], schema("observations")).write.parquet(source)
    q = observation_stream(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
