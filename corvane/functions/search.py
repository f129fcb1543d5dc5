"""Ranked search over the values of a row: exact, prefix, contains, fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import normalize_search_text, normalized_each

# Scores of the kinds of match; a fuzzy one loses its distance.
_SCORES = {"exact": 100, "prefix": 80, "contains": 60, "fuzzy": 30}
_FUZZY_LENGTH, _FUZZY_SHARE = 4, 0.25


def allowed_distance(query: str) -> int:
    """Typing errors that a query of this length may hold; -1 if it is too short for any."""
    return max(1, int(len(query) * _FUZZY_SHARE)) if len(query) >= _FUZZY_LENGTH else -1


def best_match(query: str, values: Column) -> Column:
    """The best hit struct<index, kind, score, value>, NULL without any; ties go to the earlier value.

    `query` and the strings of `values` are normalized. The edit distance is cut off at what is allowed.
    """
    q, most = F.lit(query), allowed_distance(query)

    def hit(value: Column, at: Column) -> Column:
        def scored(kind: str, score: Column) -> Column:
            return F.struct(score.alias("score"), (-at).alias("_order"), F.lit(kind).alias("kind"), value.alias("value"))

        found = F.when(value == q, scored("exact", F.lit(_SCORES["exact"]))).when(F.startswith(value, q), scored("prefix", F.lit(_SCORES["prefix"]))).when(F.contains(value, q), scored("contains", F.lit(_SCORES["contains"])))
        if most < 0:
            return found
        apart = F.levenshtein(value, q, most)
        return found.when(apart >= 0, scored("fuzzy", _SCORES["fuzzy"] - apart))

    best = F.array_max(F.filter(F.transform(values, hit), lambda h: h.isNotNull()))
    return F.when(best.isNotNull(), F.struct((-best["_order"]).alias("index"), best["kind"].alias("kind"), best["score"].alias("score"), best["value"].alias("value")))


def search(df: DataFrame, query: str, values: Column, *, is_normalized: bool = False) -> DataFrame:
    """`df` with `match`; a query that isn't blank keeps only rows with a hit, a blank one keeps all with NULL.

    The hit's value is the original one, as it stands in `values`.
    """
    q = normalize_search_text(query)
    if not q:
        return df.withColumn("match", F.lit(None).cast("struct<index:int,kind:string,score:int,value:string>"))
    prepared = df.withColumn("_values", values if is_normalized else normalized_each(values))
    hits = prepared.withColumn("match", best_match(q, F.col("_values"))).where(F.col("match").isNotNull()).drop("_values")
    return hits.withColumn("match", F.col("match").withField("value", F.element_at(values, F.col("match.index") + 1)))


def matches(query: str, normalized_values: Column) -> Column:
    """Whether a normalized query finds any of the values; a blank one finds all rows."""
    return F.lit(True) if not query else best_match(query, normalized_values).isNotNull()


def match_label(query: str, originals: Column) -> Column:
    """The value to show as hit: only if the query isn't blank and the hit isn't the first value."""
    return F.when(F.lit(bool(query.strip())) & (F.col("match.index") > 0), F.element_at(originals, F.col("match.index") + 1))
