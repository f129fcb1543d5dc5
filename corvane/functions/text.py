"""Text functions of search and ordering."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Strokes that count as a hyphen in search.
_HYPHENS = re.compile("[‐-―ー]")
_DECOMPOSED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
#: Letters with accents, the letters without, and accents that stand for themselves.
_ACCENTED = "".join(c for c, x in _DECOMPOSED.items() if x.isascii())
_PLAIN = "".join(x for x in _DECOMPOSED.values() if x.isascii())
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def normalize_search_text(value: str) -> str:
    """Compatibility form, lower case, one kind of hyphen, one blank between words."""
    folded = _HYPHENS.sub("-", unicodedata.normalize("NFKC", value).lower())
    return re.sub(r"[\s﻿]+", " ", folded).strip(" ")


@pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@pandas_udf(ArrayType(StringType()))
def _compatible_each(values: pd.Series) -> pd.Series:
    return values.map(lambda a: None if a is None else [None if v is None else unicodedata.normalize("NFKC", v) for v in a])


def _unaccented(value: Column) -> Column:
    """Latin letters without their accents, by a table of all that decompose to an ASCII letter; kana keep their voicing marks."""
    return F.translate(value, _ACCENTED + _MARKS, _PLAIN)


def _folded(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "[‐-―ー]", "-"), r"(?U)[\s\x{FEFF}]+", " "))


def normalized(value: Column) -> Column:
    """normalize_search_text for a column: only the compatibility form leaves the JVM, in Arrow batches."""
    return _folded(_compatible(value))


def normalized_each(values: Column) -> Column:
    """The same for each string of an array."""
    return F.transform(_compatible_each(values), _folded)


def register(spark: SparkSession) -> None:
    """Makes normalize_search_text known to SQL."""
    spark.udf.register("normalize_search_text", pandas_udf(lambda s: s.map(lambda v: None if v is None else normalize_search_text(v)), StringType()))


def is_ascii(value: Column) -> Column:
    """Not empty and all ASCII."""
    return value.rlike(r"^[\x00-\x7F]+\z")


def initials(name: Column, fallback: str = "AV") -> Column:
    """The first letters of the first two words, in upper case."""
    letters = F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    return F.coalesce(F.nullif(F.upper(F.array_join(F.slice(letters, 1, 2), "")), F.lit("")), F.lit(fallback))


def numeric_key(value: Column, width: int = 20) -> Column:
    """A key under which runs of digits order as numbers and neither letter case nor accents of Latin letters matter.

    Kana keep their voicing marks.
    """
    parts = F.regexp_extract_all(F.lower(_unaccented(value)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, F.greatest(F.lit(width), F.length(p)), F.lit("0"))).otherwise(p)), "")


def ordinal(number: Column, width: int = 2) -> Column:
    """A number padded with zeros, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def split_tags(value: Column) -> Column:
    """The tags of a typed list: divided at commas of either width, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(value, "[,，]"), lambda t: F.trim(t)), lambda t: t != "")


def dotted_date(value: Column) -> Column:
    return F.date_format(value, "yyyy.MM.dd")
