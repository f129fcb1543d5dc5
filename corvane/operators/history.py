"""Full history of changing entity attributes from periodic deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def latest_deliveries(df: DataFrame, key: str, date: str, arrival: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per (`key`, `date`): the delivery that arrived last.

    `arrival` orders deliveries, the first column first; NULL arrives before everything, and a full
    tie goes to the largest attribute values, so that the result doesn't depend on row order. Rows
    without key or date can't be placed in time and are left out.

    Repeats collapse on the map side; what follows holds at most one row per key and calendar date,
    however often a hot key was delivered.
    """
    order = [c for c in arrival if c not in attributes]
    newest = F.max(F.struct(*order, *attributes)).alias("_n")
    kept = df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    grouped = kept.groupBy(F.col(key).alias("_k"), F.col(date).alias("_d")).agg(newest)
    return grouped.select(F.col("_k"), F.col("_d"), *[F.col("_n")[a].alias(f"_v{i}") for i, a in enumerate(attributes)])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def change_log(latest: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The event log: (`_k`, `_a` number of the attribute, `_d` date of the change, `_value` struct with the new value).

    An attribute's first delivered value is its first event. NULL is a value of its own.
    """
    by_date = Window.partitionBy("_k").orderBy("_d")
    first = F.row_number().over(by_date) == 1
    flagged = latest.select("*", *[(first | ~_same(F.lag(f"_v{i}").over(by_date), F.col(f"_v{i}"))).alias(f"_c{i}") for i in range(len(attributes))])
    kinds = dict(latest.dtypes)

    def event(i: int) -> Column:
        values = [(F.col(f"_v{j}") if j == i else F.lit(None).cast(kinds[f"_v{j}"])).alias(f"_v{j}") for j in range(len(attributes))]
        return F.when(F.col(f"_c{i}"), F.struct(F.lit(i).alias("_a"), F.struct(*values).alias("_value")))

    events = F.array_compact(F.array(*[event(i) for i in range(len(attributes))]))
    return flagged.select("_k", "_d", F.explode(events).alias("_e")).select("_k", "_e._a", "_d", "_e._value")


def attribute_intervals(log: DataFrame) -> DataFrame:
    """The log with `_to`, the date of the attribute's next change, NULL while it still holds."""
    return log.withColumn("_to", F.lead("_d").over(Window.partitionBy("_k", "_a").orderBy("_d")))


def combine_intervals(intervals: DataFrame, width: int) -> DataFrame:
    """Versions (`_k`, `_v0`.., `_from`, `_to`): the attributes' intervals split at the union of their boundaries, equal neighbours coalesced.

    At each boundary an attribute has the value of the interval that began last. The partitioning
    by key that the log already has serves the grouping and both windows: nothing is shuffled.
    """
    at = intervals.groupBy("_k", "_d").agg(*[F.max(F.when(F.col("_a") == i, F.struct(F.col(f"_value._v{i}").alias("v")))).alias(f"_s{i}") for i in range(width)])
    so_far = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_date = Window.partitionBy("_k").orderBy("_d")
    held = at.select("_k", "_d", *[F.last(f"_s{i}", ignorenulls=True).over(so_far)["v"].alias(f"_v{i}") for i in range(width)])
    state = F.struct(*[f"_v{i}" for i in range(width)])
    changed = held.withColumn("_new", F.row_number().over(by_date) == 1).withColumn("_prev", F.lag(state).over(by_date))
    versions = changed.where(F.col("_new") | ~_same(F.col("_prev"), state))
    return versions.select("_k", *[f"_v{i}" for i in range(width)], F.col("_d").alias("_from"), F.lead("_d").over(by_date).alias("_to"))


def entity_versions(df: DataFrame, key: str, date: str, arrival: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Every version of every delivered entity: `key`, the attributes, `valid_from`, `valid_to` (NULL while open).

    Two neighbouring delivered dates belong to one version if all attributes are the same, NULL
    being a value; a date without delivery doesn't end a version. Exact repeats, late deliveries
    and deliveries out of order don't matter, as only the last arrival of each (key, date) counts.
    An empty table gives no rows; other columns of `df`, whatever their names, are not read.
    """
    latest = latest_deliveries(df, key, date, arrival, attributes)
    versions = combine_intervals(attribute_intervals(change_log(latest, attributes)), len(attributes))
    return versions.select(F.col("_k").alias(key), *[F.col(f"_v{i}").alias(a) for i, a in enumerate(attributes)], F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"))


def attribute_versions(df: DataFrame, key: str, date: str, arrival: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """The history of each attribute by itself: `key`, `attribute`, `value` (as string), `valid_from`, `valid_to` (NULL while open)."""
    spans = attribute_intervals(change_log(latest_deliveries(df, key, date, arrival, attributes), attributes))
    value, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, a in enumerate(attributes):
        value = F.when(F.col("_a") == i, F.col(f"_value._v{i}").cast("string")).otherwise(value)
        name = F.when(F.col("_a") == i, F.lit(a)).otherwise(name)
    return spans.select(F.col("_k").alias(key), name.alias("attribute"), value.alias("value"), F.col("_d").alias("valid_from"), F.col("_to").alias("valid_to"))


def as_of(versions: DataFrame, key: str, when: DataFrame, when_column: str) -> DataFrame:
    """Rows of `when` (`key`, `when_column`) with the version that held on that date, if any did.

    An equi-join on the key with the period as condition; the versions of one key are bounded by its delivered dates.
    """
    v, w = versions.alias("_ver"), when.alias("_req")
    held = (F.col(f"_ver.{key}") == F.col(f"_req.{key}")) & (F.col("_ver.valid_from") <= F.col(f"_req.{when_column}")) & (F.col("_ver.valid_to").isNull() | (F.col(f"_req.{when_column}") < F.col("_ver.valid_to")))
    return w.join(v, held, "left").select("_req.*", *[F.col(f"_ver.{c}") for c in versions.columns if c != key])
