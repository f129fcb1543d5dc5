import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from corvane.llm.cooccurrence import items_together
from tests.conftest import rows

SCHEMA = "w string, p string"


def brute(data, least, times):
    sets, n = defaultdict(set), len({w for w, _ in data if w is not None})
    for w, p in data:
        if w is not None and p is not None:
            sets[w].add(p)
    single = Counter(p for s in sets.values() for p in s)
    both = Counter(x for s in sets.values() for x in combinations(sorted(s), 2))
    return sorted((a, b, k, single[a], single[b], n) for (a, b), k in both.items() if k >= least and k * n >= times * single[a] * single[b])


def make(seed, works=400, people=60, hot=()):
    rng = random.Random(seed)
    data = []
    for w in range(works):
        team = rng.randrange(15)
        cast = {f"p{team * 4 + rng.randrange(4):02d}" for _ in range(3)} | {f"p{rng.randrange(people):02d}" for _ in range(1)}
        data += [(f"w{w}", p) for p in cast] + ([(f"w{w}", "hot")] if w % 3 else [])
    for h in hot:
        data += [(h, f"p{i:02d}") for i in range(people)]
    return data + rng.sample(data, 30) + [(None, "p01"), ("w1", None), ("lonely", None)]


@pytest.mark.parametrize("hot", [(), ("h1",), ("h1", "h2", "h3", "h4", "h5", "h6", "h7")])
def test_against_brute_force(spark, hot):
    data = make(1, hot=hot)
    got = items_together(spark.createDataFrame(data, SCHEMA), "w", "p", 5, 10, block=8)
    want = brute(data, 5, 10)
    assert want and rows(got.drop("odds_ratio")) == want


def test_blocks_of_large_records(spark):
    data = make(2, hot=("h1", "h2", "h3"))
    got = items_together(spark.createDataFrame(data, SCHEMA), "w", "p", 1, 1, block=8)
    assert rows(got.drop("odds_ratio")) == brute(data, 1, 1)


def test_odds_ratio_is_finite(spark):
    data = [(f"w{i}", p) for i in range(5) for p in "ab"] + [(f"x{i}", "c") for i in range(95)]
    row = items_together(spark.createDataFrame(data, SCHEMA), "w", "p").first()
    assert (row["n_ab"], row["n"]) == (5, 100) and row["odds_ratio"] == pytest.approx(5.5 * 95.5 / 0.25)


def test_empty_table_and_clashing_columns(spark):
    assert rows(items_together(spark.createDataFrame([], SCHEMA), "w", "p")) == []
    df = spark.createDataFrame([(f"w{i}", p, 1, 2) for i in range(60) for p in (("a", "b") if i < 6 else ("c",))], SCHEMA + ", _n int, _code int")
    assert rows(items_together(df, "w", "p").select("item_a", "item_b", "n_ab")) == [("a", "b", 6)]


def test_names_of_any_form_and_type(spark):
    """Texts are packed without loss and without mixing UUIDs, their look-alikes and texts of the lengths between."""
    from pyspark.sql import functions as F

    from corvane.llm.cooccurrence import _packed, _unpacked

    uuid = "00010203-0405-0607-0809-0a0b0c0d0eff"
    texts = [uuid, uuid.upper(), uuid[:-1], uuid + "\n", uuid.replace("-", ""), "", "\0", "\0" * 15, "\1\0" + "x" * 13, *["x" * n for n in range(12, 20)], "一" * 5, "田中"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    packed = df.select("t", _packed(df, "t").alias("p"))
    assert packed.select("p").distinct().count() == len(texts)
    assert packed.where(_unpacked(F.col("p"), df, "t") == F.col("t")).count() == len(texts)
    assert packed.where(F.col("t") == uuid).first()["p"] == bytes([*range(15), 255])
    numbers = [(int(w[1:]), float(int(p[1:]))) for w, p in make(3) if w and w[0] == "w" and p and p[0] == "p"]
    got = items_together(spark.createDataFrame(numbers, "w long, p double"), "w", "p")
    want = brute(numbers, 5, 10)
    assert want and sorted(rows(got.drop("odds_ratio"))) == want


def test_little_is_moved(spark, tmp_path):
    """No table of strings is checkpointed: what is written to disk there stays far below the input."""
    import uuid

    rng = random.Random(4)
    name = lambda: str(uuid.UUID(int=rng.getrandbits(128)))
    people = [name() for _ in range(500)]
    data = [(w, p) for w in (name() for _ in range(5000)) for p in rng.sample(people, 4)]
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    items_together(spark.createDataFrame(data, SCHEMA), "w", "p").collect()
    written = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    if before.isDefined():
        context.setCheckpointDir(before.get().rpartition("/")[0])
    assert 0 < written < 72 * len(data) / 10
