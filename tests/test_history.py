import random
from datetime import date, datetime, timedelta

from corvane.operators.history import as_of, attribute_versions, entity_versions
from tests.conftest import rows

SCHEMA = "snapshot_id long, person_id string, snapshot_date date, received_at timestamp, stage_name string, active boolean"
ARGS = ("person_id", "snapshot_date", ("received_at", "snapshot_id"), ("active", "stage_name"))
D = date(2020, 1, 1)


def brute(data):
    latest = {}
    for r in set(data):
        if r[1] is None or r[2] is None:
            continue
        rank = (r[3] or datetime.min, r[0] or -1, r[5] is not None, bool(r[5]), r[4] is not None, r[4] or "")
        if (r[1], r[2]) not in latest or latest[r[1], r[2]][0] < rank:
            latest[r[1], r[2]] = (rank, (r[5], r[4]))
    out, last = [], {}
    for (k, d), (_, v) in sorted(latest.items(), key=lambda x: x[0]):
        if k not in last or last[k][1] != v:
            if k in last:
                out.append((k, *last[k][1], last[k][0], d))
            last[k] = (d, v)
    return sorted([*out, *((k, *v, d, None) for k, (d, v) in last.items())], key=repr)


def test_random_deliveries(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        k = rng.choice(["a"] * 6 + ["b", "c", "d", None])
        data.append((i, k, rng.choice([D + timedelta(days=90 * rng.randrange(12)), D, None]), rng.choice([datetime(2021, 1, 1 + rng.randrange(5)), None]), rng.choice(["x", "y", "", None]), rng.choice([True, False, None])))
    data += rng.sample(data, 50)
    rng.shuffle(data)
    got = entity_versions(spark.createDataFrame(data, SCHEMA), *ARGS)
    assert rows(got) == brute(data)


def test_empty_table_and_clashing_columns(spark):
    assert rows(entity_versions(spark.createDataFrame([], SCHEMA), *ARGS)) == []
    df = spark.createDataFrame([(1, "a", D, None, "n", True, 1, 2, "q")], SCHEMA + ", _k int, _d int, valid_from string")
    assert rows(entity_versions(df, *ARGS)) == [("a", True, "n", D, None)]


def test_a_gap_does_not_end_a_version_and_null_is_a_value(spark):
    data = [(1, "a", D, None, None, None), (2, "a", D + timedelta(400), None, None, None), (3, "a", D + timedelta(500), None, None, True)]
    got = rows(entity_versions(spark.createDataFrame(data, SCHEMA), *ARGS))
    assert got == [("a", None, None, D, D + timedelta(500)), ("a", True, None, D + timedelta(500), None)]


def test_attributes_have_their_own_intervals(spark):
    data = [(1, "a", D, None, "x", True), (2, "a", D + timedelta(1), None, "y", True), (3, "a", D + timedelta(2), None, "y", False)]
    got = rows(attribute_versions(spark.createDataFrame(data, SCHEMA), *ARGS))
    assert got == sorted([("a", "active", "true", D, D + timedelta(2)), ("a", "active", "false", D + timedelta(2), None), ("a", "stage_name", "x", D, D + timedelta(1)), ("a", "stage_name", "y", D + timedelta(1), None)], key=repr)


def test_as_of(spark):
    data = [(1, "a", D, None, "x", True), (2, "a", D + timedelta(10), None, "y", True)]
    versions = entity_versions(spark.createDataFrame(data, SCHEMA), *ARGS)
    asked = spark.createDataFrame([("a", D + timedelta(9)), ("a", D + timedelta(10)), ("a", D - timedelta(1)), ("z", D)], "person_id string, day date")
    got = rows(as_of(versions, "person_id", asked, "day"), "person_id", "day", "stage_name")
    assert got == sorted([("a", D + timedelta(9), "x"), ("a", D + timedelta(10), "y"), ("a", D - timedelta(1), None), ("z", D, None)], key=repr)
