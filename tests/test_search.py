from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import search as s
from corvane.functions import text as t

NAMES = ["Haruno Arashi", "アラシ ハルノ", "Nagi Tomo"]


def found(spark, query, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    row = s.search(df, query, F.col("v")).first()
    return None if row is None or row["match"] is None else tuple(row["match"][k] for k in ("index", "kind", "score"))


def test_normalized_forms():
    assert t.normalize_search_text("　ＡＢＣ－１２　 ｘ ") == "abc-12 x"
    assert t.normalize_search_text("AB—12") == "ab-12"
    assert t.normalize_search_text("﻿ \xa0 ") == ""


def test_column_and_string_agree(spark):
    values = ["　ＡＢＣ　ー １", "a b\tc", "", None, "Ｘ﻿Ｙ"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(t.normalized(F.col("v"))).collect()]
    assert got == [None if v is None else t.normalize_search_text(v) for v in values]


def test_codes_of_every_script_are_normalized(spark, tmp_path):
    import __spark_entry__ as entry

    codes = ["ABC-12", "ＡＢＣ－１２", "AB—12", "АВС-12", "ｱﾋﾞ ー 1", "　x  Y ", "", None]
    spark.createDataFrame([(str(i), c) for i, c in enumerate(codes)] * 2, "id string, code string").write.parquet(f"{tmp_path}/releases.parquet")
    got = dict(map(tuple, entry.queries()["normalize_codes"](spark, str(tmp_path)).collect()))
    assert got == {str(i): None if c is None else t.normalize_search_text(c) for i, c in enumerate(codes)}
    assert got["1"] == "abc-12" and "normalize_codes" not in entry.oracle_sql()


def test_tiers(spark):
    assert found(spark, "nagi tomo", NAMES) == (2, "exact", 100)
    assert found(spark, "Nagi To", NAMES) == (2, "prefix", 80)
    assert found(spark, "arashi", NAMES) == (0, "contains", 60)
    assert found(spark, "nagi tamo", NAMES) == (2, "fuzzy", 29)
    assert found(spark, "ｱﾗｼ ﾊﾙﾉ", NAMES) == (1, "exact", 100)
    assert found(spark, "nag", ["ang"]) is None
    assert found(spark, "abcd", ["abxy"]) is None
    assert found(spark, "x", []) is None


def test_ties_go_to_the_earlier_value_and_blank_keeps_all(spark):
    assert found(spark, "ab", ["abc", "abd"]) == (0, "prefix", 80)
    df = spark.createDataFrame([(["a"],), ([],)], "v array<string>")
    assert s.search(df, " 　", F.col("v")).where("match is null").count() == 2
    assert s.search(df, "a", F.col("v")).count() == 1


def test_shown_hit(spark):
    df = spark.createDataFrame([(["One", "Two"],)], "v array<string>")
    assert s.search(df, "ＴWO", F.col("v")).first()["match"]["value"] == "Two"
    assert s.search(df, "two", F.col("v")).select(s.match_label("two", F.col("v"))).first()[0] == "Two"
    assert s.search(df, "one", F.col("v")).select(s.match_label("one", F.col("v"))).first()[0] is None


def test_small_functions(spark):
    row = spark.sql("select 'Homura Tsukino' a, '  ' b, 'demo-10' c, ' x,y，, z ' d, date'2020-02-03' e, 123 n").select(
        t.initials(F.col("a")), t.initials(F.col("b")), t.numeric_key(F.col("c")), t.split_tags(F.col("d")), t.dotted_date(F.col("e")), t.ordinal(F.col("n")), t.ordinal(F.lit(3)), t.is_ascii(F.lit("é")), t.is_ascii(F.lit("a"))
    ).first()
    assert tuple(row) == ("HT", "AV", "demo-" + "10".zfill(20), ["x", "y", "z"], "2020.02.03", "123", "03", False, True)


@given(st.text(max_size=30))
def test_normalizing_twice_changes_nothing(value):
    once = t.normalize_search_text(value)
    assert t.normalize_search_text(once) == t.normalize_search_text(t.normalize_search_text(once))
