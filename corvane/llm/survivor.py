"""The best representative of each group of duplicate records, field by field."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field in the election: its value, the form under which equal values join their votes, and the trust in a row's value."""

    value: Column
    trust: Column
    normal: Column | None = None


def recency(stamp: Column, as_of: Column, half_life_days: float, least: float = 0.5) -> Column:
    """A weight that falls from 1 to `least` as `stamp` lies further before `as_of`; half of the way in each half-life. NULL weighs `least`."""
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros(stamp)) / F.lit(86_400e6 * half_life_days), F.lit(0.0))
    return F.coalesce(F.lit(least) + (1 - least) * F.pow(F.lit(0.5), age), F.lit(least))


def field_votes(records: DataFrame, group: str, fields: Mapping[str, Field], decay: Column, stamp: Column) -> DataFrame:
    """Long rows (`_group`, `_field`, `_normal`, `value`, `vote`, `newest`), votes summed per normalised value.

    Every value that isn't NULL votes with trust times decay. Values are strings here. Each row is
    unpivoted in place, and votes are added up before the shuffle, so that a group that holds a third
    of all rows sends no more than its different values from each task. Of a value's spellings the
    newest, then the smallest, stands for all.
    """
    entries = [F.struct(F.lit(name).alias("field"), f.value.cast("string").alias("value"), (f.value if f.normal is None else f.normal).cast("string").alias("normal"), (f.trust.cast("double") * decay).alias("vote")) for name, f in fields.items()]
    long = records.select(F.col(group).alias("_group"), stamp.alias("newest"), F.explode(F.array(*entries)).alias("_e")).where(F.col("_e.normal").isNotNull() & F.col("_group").isNotNull())
    grouped = long.groupBy("_group", F.col("_e.field").alias("_field"), F.col("_e.normal").alias("_normal"))
    shown = F.max_by(F.col("_e.value"), F.struct(F.col("newest"), F.col("_e.value")))
    return grouped.agg(F.sum("_e.vote").alias("vote"), F.max("newest").alias("newest"), shown.alias("value"))


def elect(votes: DataFrame) -> DataFrame:
    """(`_group`, `_field`, `value`, `vote`): of each field the value with the most votes, then the newest, then the largest in string order.

    Votes are compared by their logarithm to nine decimals, so that the order of summation doesn't decide.
    """
    order = F.struct(F.round(F.log2("vote"), 9), F.col("newest"), F.col("value"))
    return votes.groupBy("_group", "_field").agg(F.max_by("value", order).alias("value"), F.max("vote").alias("vote"))


def best_representative(records: DataFrame, group: str, fields: Mapping[str, Field], decay: Column, stamp: Column) -> DataFrame:
    """(`group`, one column per field): the surviving record of each group, built field by field.

    `fields` are unpivoted to long rows, votes (source trust times recency decay) are summed per
    normalised value, the winner of each field is the value with the most votes, and the winners are
    pivoted back. Ties go to the newest, then the largest value. A field of which a group has no
    value comes out NULL, a group without any value not at all; rows without group are left out. A
    group of one row survives as it is. `records` should hold each row once: repeats vote again.
    Result columns are strings. Other columns of `records`, whatever their names, are not read.
    """
    elected = elect(field_votes(records, group, fields, decay, stamp))
    winners = elected.groupBy("_group").agg(*[F.max(F.when(F.col("_field") == name, F.col("value"))).alias(f"_w_{i}") for i, name in enumerate(fields)])
    return winners.select(F.col("_group").alias(group), *[F.col(f"_w_{i}").alias(name) for i, name in enumerate(fields)])
