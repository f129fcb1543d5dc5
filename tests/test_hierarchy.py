import random

import pytest

from corvane.operators import hierarchy as h
from tests.conftest import rows


def brute(links):
    up = {}
    for k, p in links:
        if k is not None:
            k = k.lower()
            up.setdefault(k, None)
            if p is not None:
                up[k] = min(x for x in (up[k], p.lower()) if x is not None)
    up = {k: p if p in up else None for k, p in up.items()}
    out = []
    for k in up:
        seen, x = [], k
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        out.append((k, seen[-1], len(seen) - 1, False) if x is None else (k, min(seen[seen.index(x) :]), -1, True))
    return sorted(out, key=repr)


def solve(spark, links):
    clean = h.clean_links(spark.createDataFrame(links, "id string, up string"), "id", "up")
    return clean, h.resolve_forest(clean)


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed, monkeypatch):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(150)]
    links = [(k, rng.choice([None, "missing", rng.choice(ids).upper(), rng.choice(ids)])) for k in ids]
    links += rng.sample(links, 20) + [(None, "n001"), (None, None)]
    monkeypatch.setattr(h, "FOREST_ROWS", 7)
    assert rows(solve(spark, links)[1]) == brute(links)


def test_long_chain_and_long_circle(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(700)] + [("c0700", None)]
    circle = [(f"r{i:04d}", f"r{(i + 1) % 300:04d}") for i in range(300)] + [("into", "r0123"), ("self", "self")]
    got = rows(solve(spark, chain + circle)[1])
    assert got == brute(chain + circle)


def test_empty_table(spark):
    clean, forest = solve(spark, [])
    assert rows(forest) == [] and rows(h.materialise_paths(clean, forest)) == []


def test_paths_and_descendants(spark):
    links = [("a", None), ("b", "A"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")]
    clean, forest = solve(spark, links)
    paths = h.materialise_paths(clean, forest)
    assert rows(paths) == [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"]), ("d", ["a", "b", "c", "d"])]
    assert rows(h.descendants(paths)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, "1", "2", "3")], "id string, up string, _known string, anc string, root string")
    assert rows(h.resolve_forest(h.clean_links(df, "id", "up"))) == [("a", "a", 0, False)]


def test_one_root_with_a_third_of_the_rows(spark):
    links = [("hub", None), *((f"leaf{i:04d}", "hub") for i in range(500)), *((f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(1000))]
    got = {r["id"]: (r["root"], r["depth"]) for r in h.resolve_forest(spark.createDataFrame(links, "id string, up string").repartition(7)).collect()}
    assert all(got[f"leaf{i:04d}"] == ("hub", 1) for i in range(500)) and got["n0999"] == ("n0000", 999) and len(got) == 1501
