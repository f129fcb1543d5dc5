from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corvane.llm.survivor import Field, best_representative, recency
from corvane.llm.survivor_queries import slug_form
from tests.conftest import rows

SCHEMA = "g string, id string, name string, trust double, at timestamp"
T = datetime(2024, 1, 1)


def survivors(spark, data, schema=SCHEMA):
    df = spark.createDataFrame(data, schema)
    fields = {"id": Field(F.col("id"), F.col("trust")), "name": Field(F.col("name"), F.col("trust"), F.lower("name"))}
    return best_representative(df, "g", fields, recency(F.col("at"), F.lit(T), 365), F.col("at"))


def test_votes_add_up_over_spellings(spark):
    data = [("g", "a", "Nagi", 1.0, T), ("g", "b", "other", 1.5, T), ("g", "c", "NAGI", 1.0, T - timedelta(10))]
    assert rows(survivors(spark, data)) == [("g", "b", "Nagi")]


def test_recency_decides_among_equal_trust_and_never_outweighs_half(spark):
    data = [("g", "a", None, 1.0, T - timedelta(9)), ("g", "b", None, 1.0, T - timedelta(8)), ("h", "a", None, 4.0, None), ("h", "b", None, 1.0, T)]
    assert rows(survivors(spark, data)) == [("g", "b", None), ("h", "a", None)]


def test_ties_nulls_and_single_rows(spark):
    data = [("g", "a", "", 1.0, T), ("g", "b", "", 1.0, T), ("one", "x", "n", 1.0, None), (None, "y", "n", 1.0, T), ("void", None, None, 1.0, T)]
    assert rows(survivors(spark, data)) == [("g", "b", ""), ("one", "x", "n")]


def test_empty_table_and_clashing_columns(spark):
    assert rows(survivors(spark, [])) == []
    data = [("g", "a", "x" * 100_000, 1.0, T, "1", "2", 3.0)]
    assert rows(survivors(spark, data, SCHEMA + ", value string, _field string, vote double")) == [("g", "a", "x" * 100_000)]


def test_order_of_rows_does_not_matter(spark):
    data = [("g", f"i{i}", f"n{i % 3}", 0.1 * (i % 7), T - timedelta(i)) for i in range(40)]
    assert rows(survivors(spark, data)) == rows(survivors(spark, data[::-1]))


def test_slugs(spark):
    df = spark.createDataFrame([(" A_b  C ",), ("a-b-c",), ("　a--b c-",)], "s string")
    assert rows(df.select(slug_form(F.col("s")).alias("s")).distinct()) == [("a-b-c",)]
