from datetime import date

from corvane.llm import names as n
from corvane.llm.components import connected
from corvane.llm.variant_queries import people_entities, people_names, people_rows
from corvane.llm.variants import CHANCE, candidates, character_forms, resolve, variant_groups
from tests.conftest import rows

PEOPLE = "id string, slug string, primary_name string, name_ja string, name_zh string, name_en string, birth_date date, birth_date_precision string, birthplace string"
ALIASES = "id string, person_id string, name string"
D = date(1970, 3, 17)


def person(i, slug, name, ja=None, zh=None, en=None, born=D, precision="day", place="灯川町"):
    return (i, slug, name, ja, zh, en, born, precision, place)


BASE = [
    person("1", "s1", "霜沢陽葉", "霜沢陽葉", "霜泽阳叶", "Haruha Shimosawa"),
    person("2", "s2", "霜沢陽葉", "霜沢陽葉", "霜泽阳叶", "Haruha Shimosawa", date(1981, 5, 6), place="砂谷町"),
    person("3", "s3", "桂倉礼斗", "桂倉礼斗", "桂仓礼斗", "Akito Katsurakura", date(1990, 8, 20)),
    person("4", "s4", "桂倉陽葉", "桂倉陽葉", None, "Haruha Katsurakura", date(1966, 9, 9)),
    # others, so that dates and places are as rare as in a catalog
    *[person(f"o{i}", f"other-{i}", f"露{i % 9}橋{i}", born=date(1950 + i % 45, 1 + i % 12, 2 + i % 25), place=f"{'甲乙丙丁戊己庚辛壬癸'[i % 10]}川町") for i in range(150)],
]


def groups(spark, tmp_path, people, aliases=()):
    folder = str(tmp_path)
    spark.createDataFrame(people, PEOPLE).write.parquet(f"{folder}/people.parquet")
    spark.createDataFrame(list(aliases), ALIASES).write.parquet(f"{folder}/person_aliases.parquet")
    r = people_rows(spark, folder)
    forms = character_forms(r, "name_ja", "name_zh")
    typed, dictionary = people_names(r, spark, folder, forms)
    entities, _ = people_entities(r, forms)
    found = {}
    for e, g in rows(variant_groups(typed, dictionary, entities)):
        found.setdefault(g, set()).add(e)
    return sorted(map(sorted, found.values()))


TYPED = ["Shimosawa,Haruha", "HARUHA SHIMOSAWA", "H.SHIMOSAWA", "Shimosawa H.", "霜泽阳叶", "霜澤陽葉", "陽葉 霜沢", "霜沢 はるは", "シモサワ・ハルハ", "しもさわはるは", "霜沢はるちゃん", "はるたん（霜沢）", "Haru-chan Shimosawa", "霜沢　陽葉さん", "Haruha Simosawa", "Hauha Shimosaaw"]


def test_typed_variants_are_linked(spark, tmp_path):
    typed = [person(f"t{i:02d}", f"t{i:02d}", name) for i, name in enumerate(TYPED)]
    assert groups(spark, tmp_path, [*BASE, *typed]) == [["s1", *(t[1] for t in typed)]]


def test_namesakes_are_not_linked(spark, tmp_path):
    assert groups(spark, tmp_path, [*BASE, person("9", "s9", "Shimosawa,Haruha", born=date(1999, 1, 12))]) == []
    # without date or place, two persons bear the name
    assert groups(spark, tmp_path / "b", [*BASE, person("9", "s9", "Shimosawa,Haruha", born=None, place=None)]) == []


def test_names_of_other_lengths(spark, tmp_path):
    taught = [person("k1", "k1", "森 美咲", None, None, "Misaki Mori", date(1961, 2, 3)), person("k2", "k2", "佐々木 健太", None, None, "Kenta Sasaki", date(1962, 2, 3)), person("k3", "k3", "桜井美咲", None, None, "Misaki Sakurai", date(1963, 2, 3)), person("k4", "k4", "佐々木 健", None, None, "Ken Sasaki", date(1964, 2, 3))]
    typed = [("森美咲", 0), ("佐々木健太", 1), ("美咲桜井", 2), ("佐々木健", 3), ("桜丼美咲", 2), ("MSakurai", 2), ("Misaki K. Sakurai", 2), ("Dr Misaki Sakurai", 2), ("Misaki-chan", 2), ("Misaki", 2), ("Misaki Skauria", 2), ("Misaki Sakurrrai", 2)]
    people = [person(f"t{i:02d}", f"t{i:02d}", name, born=taught[k][6]) for i, (name, k) in enumerate(typed)]
    expected = {k: {f"k{k + 1}", *(f"t{i:02d}" for i, (_, j) in enumerate(typed) if j == k)} for k in range(4)}
    assert groups(spark, tmp_path, [*BASE, *taught, *people]) == sorted(map(sorted, expected.values()))


def test_stage_names_of_one_word_link_nobody_else(spark, tmp_path):
    assert groups(spark, tmp_path, [*BASE, person("9", "s9", "Haruha Katsuragi", born=None, place=None)], [("a", "1", "HARUHA"), ("b", "4", "Haruha"), ("c", "9", "HARUHA")]) == []


def test_aliases_are_names_in_every_script(spark, tmp_path):
    stage = [person("7", "s7", "鯉森栞太"), person("8", "s8", "Tamino Koiwa"), person("9", "s9", "鯉森栞太", born=date(1999, 1, 12), place="砂谷町")]
    assert groups(spark, tmp_path, [*BASE, *stage], [("a", "1", "鯉森栞太（艺名）"), ("b", "1", "コイワ タミノ"), ("c", "3", "鯉森栞太")]) == [["s1", "s7", "s8"]]


def linked(spark, entities, kind="R"):
    schema = "entity string, date date, level int, year int, place string, p_day double, p_year double, p_place double"
    known = spark.createDataFrame([(e, d, level, d and d.year, place, 1e-4, 0.025, 0.01) for e, d, level, place in entities], schema)
    forms = known.selectExpr("entity", "7L h", f"'{kind}' kind", "'b' side", "0 slips", "cast(null as long) name")
    return {r[:2] for r in rows(candidates(forms, known).where(f"chance <= {CHANCE}"), "a", "b")}


def test_forms_of_many_entities(spark):
    # 25 spellings of one person: those with the year only and those without date fit
    one = [(f"s{i:02d}", D, 3, "灯川町") for i in range(23)]
    got = linked(spark, [*one, ("year", date(1970, 1, 1), 1, None), ("z", None, 0, None)])
    assert len(got) == 25 * 24 // 2 and ("s00", "year") in got and ("s00", "z") in got and ("year", "z") in got
    # 25 namesakes: without date only a rare place tells who is meant
    many = [(f"s{i:02d}", date(1950 + i, 3, 17), 3, f"{i}") for i in range(25)]
    assert linked(spark, [*many, ("z", None, 0, "7"), ("y", None, 0, "7"), ("x", None, 0, None), ("a", None, 0, "none")]) == {("s07", "z"), ("s07", "y"), ("y", "z")}
    # namesakes of one year count each
    assert linked(spark, [("s1", D, 3, None), ("s2", date(1970, 8, 2), 3, None), ("z", None, 0, None)]) == set()


def test_a_form_of_a_thousand(spark):
    # a third as many days as bearers: each day links among itself, the others don't
    many = [(f"s{i:04d}", date(1950 + i % 333 // 12, 1 + i % 333 % 12, 17), 3, None) for i in range(999)]
    got = linked(spark, [*many, ("z", None, 0, None)])
    assert got == {(f"s{a:04d}", f"s{b:04d}") for i in range(333) for a in (i, i + 333) for b in (i + 333, i + 666) if a < b}


def test_one_wrong_sign_needs_a_date(spark):
    assert linked(spark, [("a", D, 3, None), ("b", D, 3, None), ("c", None, 0, None)], "X") == {("a", "b")}


def test_groups_hold_no_two_dates(spark):
    entities = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3), ("y", 1), ("z", 0), ("w", 0)], "entity string, level int")
    links = [("a", "b", 1e-4), ("a", "y", 0.01), ("c", "y", 0.2), ("c", "z", 0.1), ("b", "z", 0.15), ("w", "z", 0.3)]
    found = {}
    for e, g in rows(resolve(spark.createDataFrame(links, "a string, b string, chance double"), entities)):
        found.setdefault(g, set()).add(e)
    # y fits a best; z fits two groups about equally well, so it joins neither and stays with w
    assert sorted(map(sorted, found.values())) == [["a", "b", "y"], ["w", "z"]]


def test_nulls_repeats_and_blank_names(spark, tmp_path):
    odd = [(None,) * 9, person("5", None, None, born=None, place=None), person("6", "", "", born=None), person("7", "s7", "​ 　"), person("8", "s8", "x" * 20_000), *BASE, *BASE]
    assert groups(spark, tmp_path, odd, [("a", None, None), ("b", "1", "Shimosawa Haruha"), ("c", "1", "")]) == []


def test_empty_tables(spark, tmp_path):
    assert groups(spark, tmp_path, []) == []


def test_readings_agree_over_systems():
    for a, b in (("Syuzi Tutiya", "Shuji Tsuchiya"), ("Yūko Ōno", "Yuuko Oono"), ("じゅんいち", "Junichi"), ("ふじつか", "Huzituka"), ("Shimbashi", "しんばし")):
        assert n.reading(a) == n.reading(b), (a, b)
    assert n.kana_to_latin("キャット") == "kyatto" and n.kana_to_latin("コーヒー") == "koohii"


def test_deletions_meet_after_one_slip():
    for a, b in (("shimosawa", "shimosaaw"), ("haruha", "hruha"), ("haruha", "harwha"), ("haruha", "haruhaa")):
        assert n.deletions(a) & n.deletions(b)


def test_legal_forms():
    assert n.parse("株式会社灯屋") == n.parse("灯屋") and n.parse("Lamp House Inc.") == n.parse("Lamp House")


def test_components(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = dict(rows(connected(spark.createDataFrame(links, "a string, b string"))))
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x" and "z" not in got
    assert rows(connected(spark.createDataFrame([], "a string, b string"))) == []
