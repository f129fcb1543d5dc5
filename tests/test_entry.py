import importlib
import importlib.util

import pytest


def test_names_agree():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p5_found", "catalog_works"} <= set(queries)


def test_works_without_the_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("corvane.llm") else find(name, *a))
    import __spark_entry__ as entry

    reloaded = importlib.reload(entry)
    assert "p1_found" in reloaded.queries() and not any(q.startswith("p8") for q in reloaded.queries())
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "catalog_people", "search_fuzzy"])
def test_query_against_sql(spark, name):
    from pathlib import Path

    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data here")
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)
