import json
from datetime import date

import pytest

from corvane.llm import linkage as lk
from corvane.llm.linkage_queries import p3_confidence, p3_found
from tests.conftest import rows
from tests.llm.test_variants import ALIASES, BASE, PEOPLE, person

OBSERVATIONS = "entity_type string, entity_id string, source_url string, field_path string, observed_value string"


@pytest.mark.parametrize(
    ("value", "want"),
    [("1975-09-04", (date(1975, 9, 4), 3)), ("19750904", (date(1975, 9, 4), 3)), ("04.09.1975", (date(1975, 9, 4), 3)), ("1975/9/4", (date(1975, 9, 4), 3)), ("1975年9月4日", (date(1975, 9, 4), 3)), ("4 September 1975", (date(1975, 9, 4), 3)), ("Sept 4, 1975", (date(1975, 9, 4), 3)), ({"year": 1975, "month": 9}, (date(1975, 9, 1), 2)), ("1975-09", (date(1975, 9, 1), 2)), ("1967年頃", (date(1967, 1, 1), 1)), ("昭和50年9月4日", (date(1975, 9, 4), 3)), ("1975", (date(1975, 1, 1), 1)), (1975, (date(1975, 1, 1), 1)), ("1975-02-31", (date(1975, 1, 1), 1)), ("soon", None), (None, None), (True, None), ({"month": 3}, None)],
)
def test_dates_in_all_forms(value, want):
    assert lk.read_date(value) == want


def found(spark, tmp_path, pages, people=BASE, query=p3_found):
    data = [(kind, None, url, field, raw) for kind, url, stated in pages for field, raw in stated]
    spark.createDataFrame(data, OBSERVATIONS).write.parquet(f"{tmp_path}/observations.parquet")
    spark.createDataFrame(people, PEOPLE).write.parquet(f"{tmp_path}/people.parquet")
    spark.createDataFrame([], ALIASES).write.parquet(f"{tmp_path}/person_aliases.parquet")
    return rows(query(spark, str(tmp_path)))


def page(url, name=None, born=None, place=None, kind="person"):
    stated = [("nameJa", name), ("profile.birth_date", born), ("birthplace", place)]
    return (kind, url, [(f, json.dumps(v)) for f, v in stated if v is not None])


def test_noisy_pages(spark, tmp_path):
    pages = [
        page("exact", "霜沢陽葉", "1970-03-17"), page("kana", "シモサワ ハルハ", "1970年3月17日"), page("slip", "霜沢陽葉", "18.03.1970"), page("swapped", "桂倉礼斗", "1990-08-20", kind="PERSON"), page("place only", "霜沢陽葉", None, "砂谷町出身"),
        page("short", "桂倉礼", "1990-08-20"), page("family", "桂倉", "1990-08-20"), page("wrong sign", "桂森礼斗", "1990-08-20"), page("letters", "Katsurakura Akito", {"year": 1990, "month": 8}), page("unknown", "鯉森栞太", "1990-08-20"), page("namesake", "霜沢陽葉", "1955-11-12"), page("ambiguous", "霜沢陽葉"), page("a work", "霜沢陽葉", "1970-03-17", kind="work"), page("nothing"),
    ]
    got = dict(found(spark, tmp_path, pages))
    assert got == {"exact": "1", "kana": "1", "slip": "1", "swapped": "3", "place only": "2", "short": "3", "family": "3", "wrong sign": "3", "letters": "3"}


def test_places_tell_namesakes_apart_at_every_number(spark, tmp_path):
    # 24 of one name, each from another place; what else there is makes places rare
    many = [person(f"n{i:02d}", f"n{i:02d}", "鯉森栞太", born=date(1950 + i, 5, 9), place=f"{chr(0x5DDD + i)}谷町") for i in range(24)]
    pages = [page("placed", "鯉森栞太", None, chr(0x5DDD + 7) + "谷町"), page("elsewhere", "鯉森栞太", None, "遠谷町"), page("nothing else", "鯉森栞太")]
    assert found(spark, tmp_path, pages, [*BASE, *many]) == [("placed", "n07")]


def test_nulls_and_corrupt_values(spark, tmp_path):
    pages = [("person", "u", [("name_ja", None), (None, '"霜沢陽葉"'), ("birth_date", "{oops"), ("birthplace", "null"), ("name_ja", "7")]), (None, "v", [("name_ja", '"桂倉礼斗"')]), ("person", None, [("name_ja", '"桂倉礼斗"')])]
    assert found(spark, tmp_path, pages) == []


def test_empty_tables_and_confidence(spark, tmp_path):
    assert found(spark, tmp_path / "a", [], []) == []
    (row,) = found(spark, tmp_path / "b", [page("exact", "霜沢陽葉", "1970-03-17", "灯川町")] * 2, query=p3_confidence)
    assert row[:2] == ("exact", "1") and 0.5 < row[2] <= 1


def test_slips_of_many_names_are_sought_at_once(monkeypatch):
    """A batch of names asks the filter a few times, not once for each name, and gives what names alone give."""
    import numpy as np
    import pandas as pd

    from corvane.llm import variants
    from corvane.llm.filters import BITS
    from corvane.llm.names import Parts

    names = [(f"k{i}{j}", f"sa{'kmt'[i % 3]}u{'rnh'[i // 3]}a", f"ha{'rnk'[j % 3]}o{'mst'[j // 3]}i") for i in range(9) for j in range(9)]
    forms = {k: variants.slips(Parts("full", a, b), (a, a), (b, b)) for k, a, b in names}
    wanted = sorted({f for fs in forms.values() for f in fs})[::7]
    bits = np.zeros(BITS, np.uint8)
    bits[(variants.form_hashes(wanted).view(np.int64) % BITS).astype(np.int64)] = 1
    calls = []
    asks = variants.passes
    monkeypatch.setattr(variants, "passes", lambda *a: calls.append(1) or asks(*a))
    keep = type("Keep", (), {"value": np.packbits(bits)})
    batch = pd.DataFrame([(k, "full", a, b, "F", a, a, b, b, True) for k, a, b in names], columns=["entity", "kind", "first", "second", "order", "first_f", "first_g", "second_f", "second_g", "latin"])
    (got,) = lk._forms("entity", False, keep)(iter([batch]))
    found_forms = {(k, f) for k, f in got.itertuples(index=False) if f.startswith("D")}
    assert found_forms == {(k, f) for k, fs in forms.items() for f in fs if f in set(wanted)}
    assert len(calls) <= 3


def test_each_pair_once_at_every_date(spark):
    """However many forms two ends share they make one edge, that of the form which the fewest bear, whichever side lacks a date."""
    dates = {"day": date(1970, 3, 17), "year": date(1970, 1, 1), "none": None}
    levels = {"day": 3, "year": 1, "none": 0}
    stated = [(f"p {k}", f"D{form}", dates[k], levels[k], "a") for k in dates for form in ("x|y", "x|z", "x|z", "w|y")]
    asked = spark.createDataFrame(stated, "page string, form string, date date, level int, place string")
    schema = "entity string, date date, level int, year int, place string, p_day double, p_year double, p_place double"
    known = spark.createDataFrame([(f"e {k}", dates[k], levels[k], dates[k] and 1970, "a", 1e-4, 0.02, 0.01) for k in dates] + [("e other", date(1980, 5, 6), 3, 1980, "b", 1e-4, 0.02, 0.01)], schema)
    forms = [(f"e {k}", f"D{form}") for k in dates for form in ("x|y", "x|z", "x|z")] + [("e other", "Dx|z"), ("e other", "Du|v")]
    offered = spark.createDataFrame(forms, "entity string, form string")
    got = rows(lk.attribute_edges(asked, offered, known), "page", "entity", "by", "bearers", "pp", "ep")
    by = lambda p, e: "none" if "none" in (p, e) else "day" if p == e == "day" else "year"
    assert got == sorted((f"p {p}", f"e {e}", by(p, e), 1, "a", "a") for p in dates for e in dates)


def test_shuffles_are_freed_step_by_step(spark, tmp_path):
    """Once the steps are computed none of their shuffles is left on disk, without any garbage collection."""
    import time

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for f in files.getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}

    people = [*BASE, person("n", "n", "霜沢陽葉", born=None)]
    spark.createDataFrame(people, PEOPLE).write.parquet(f"{tmp_path}/people.parquet")
    spark.createDataFrame([("a", "1", "Haruha Shimosawa")], ALIASES).write.parquet(f"{tmp_path}/person_aliases.parquet")
    data = [(kind, None, url, field, raw) for kind, url, stated in [page("exact", "霜沢陽葉", "1970-03-17", "灯川町"), page("kana", "シモサワ ハルハ", "1970年3月17日")] for field, raw in stated]
    spark.createDataFrame(data, OBSERVATIONS).write.parquet(f"{tmp_path}/observations.parquet")
    kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(kept)
    made = p3_found(spark, str(tmp_path))
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(kept) == setting
    assert rows(made) == rows(made) == [("exact", "1"), ("kana", "1")]
