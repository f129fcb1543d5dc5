import unicodedata

from pyspark.sql import functions as F

from corvane.llm.visual_forms import look_alike_form, readable_form, visual_classes, visual_pairs
from tests.conftest import rows

SCHEMA = "owner string, id string, value string"


def same(spark, *values):
    df = spark.createDataFrame([("o", str(i), v) for i, v in enumerate(values)], SCHEMA)
    return len(rows(visual_classes(df, ["owner"], "value").select("form").distinct())) == 1


def test_what_looks_the_same(spark):
    assert same(spark, "ＡＢ－１２", "AB-12", "AВ‐12", "A​B−12", " AB-12　", "AB‑12-")
    assert same(spark, "ベランダ", "べランダ", "ﾍﾞﾗﾝﾀﾞ", "ベランダ", unicodedata.normalize("NFD", "ベランダ"))
    assert same(spark, "カメラ", "力メラ") and same(spark, "⽔族館", "水族館", "水︀族館", "水\U000e0100族館")
    assert same(spark, "café x", "café\xa0x", "саfé x")


def test_what_does_not(spark):
    for a, b in (("ab", "Ab"), ("a-b", "ab"), ("a b", "ab"), ("か", "が"), ("つ", "っ"), ("え", "エ"), ("a!", "a"), ("é", "e"), ("a--b", "a-b"), ("O1", "01")):
        assert not same(spark, a, b), (a, b)


def test_pairs_against_brute_force(spark):
    values = ["AB-1", "ＡＢ-1", "AB‐1", "AB-1", "AB-2", None, "", " ", "​", "ab-1"]
    df = spark.createDataFrame([("o" if i % 2 else "q", f"i{i}", v) for i, v in enumerate(values)] * 2, SCHEMA)
    groups = [{0, 1, 2, 3}, {6, 7, 8}]
    want = sorted((o, f"i{a}", f"i{b}") for g in groups for a in g for b in g if a < b and values[a] != values[b] and a % 2 == b % 2 for o in ["o" if a % 2 else "q"])
    assert rows(visual_pairs(df, ["owner"], "id", "value")) == want
    one = df.withColumn("owner", F.lit(None).cast("string"))
    assert len(rows(visual_pairs(one, ["owner"], "id", "value"))) == sum(1 for g in groups for a in g for b in g if a < b and values[a] != values[b])


def test_canonical_member_is_the_commonest_spelling(spark):
    df = spark.createDataFrame([("o", "1", "レコ一ド"), ("o", "2", "レコード"), ("o", "3", "レコード"), ("o", "4", None)], SCHEMA)
    assert rows(visual_classes(df, ["owner"], "value").select("id", "form", "spellings")) == [("1", "レコード", 2), ("2", "レコード", 2), ("3", "レコード", 2), ("4", None, None)]


def test_empty_table_long_text_and_clashing_columns(spark):
    assert rows(visual_pairs(spark.createDataFrame([], SCHEMA), ["owner"], "id", "value")) == []
    long = "Ａ​" * 100_000
    df = spark.createDataFrame([("o", "1", long, "x", 5), ("o", "2", "A" * 100_000, "y", 6)], SCHEMA + ", _text string, _n int")
    assert rows(visual_pairs(df, ["owner"], "id", "value")) == [("o", "1", "2")]
    assert len(visual_classes(df, ["owner"], "value").columns) == 7


def test_forms_are_stable(spark):
    text = spark.createDataFrame([("　ＡВ​－ベ",)], "v string")
    once = text.select(readable_form(F.col("v")).alias("v"))
    assert once.first()[0] == once.select(readable_form(F.col("v"))).first()[0]
    assert once.select(look_alike_form(F.col("v"))).first()[0] == "AB-べ"
