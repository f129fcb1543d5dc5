"""Matching records of two sources that share no key by several partial, noisy attributes."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.names import Parts, is_han
from corvane.llm.variants import SPLIT, UNSEEN, kept, parts_of, persons, rewritings, slip_forms, slip_parts
from corvane.session import cut_lineage

_MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}
# First years of Japanese eras.
_ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}


def _made(y: int, m: int | None = None, d: int | None = None) -> tuple[date, int] | None:
    try:
        return (date(y, m or 1, d or 1), 3 if d else 2 if m else 1) if 1800 <= y <= 2200 else None
    except ValueError:
        return None


def read_date(value: object) -> tuple[date, int] | None:
    """Date and level (3 day, 2 month, 1 year) of a stated date in any of its forms; None if none is stated.

    Objects with year, month and day; ISO and compact digits; day first with dots; year first with slashes; years, months
    and days marked in Chinese or Japanese, with eras; month names in English. An approximate year counts as a year.
    """
    if isinstance(value, dict):
        num = {k: int(v) for k, v in value.items() if k in ("year", "month", "day") and str(v).isdigit()}
        return _made(num["year"], num.get("month"), num.get("day")) if "year" in num else None
    if value is None or isinstance(value, bool):
        return None
    text = unicodedata.normalize("NFKC", str(value)).strip().lower()
    for era, start in _ERAS.items():
        text = re.sub(era + r"(元|\d+)年", lambda m, s=start: f"{s - 1 + (1 if m[1] == '元' else int(m[1]))}年", text)
    about = re.search(r"頃|ごろ|约|約|左右|circa|^c\.|^ca\.|about|年代|\?", text) is not None
    if m := re.search(r"(\d{4})\s*年\s*(?:(\d{1,2})\s*月)?\s*(?:(\d{1,2})\s*[日号])?", text):
        y, mo, d = m.groups()
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)", text):
        y, mo, d = m.groups()
    elif m := re.search(r"(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?", text):
        y, mo, d = m.groups()
    elif m := re.search(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", text):
        d, mo, y = m.groups()
    elif (m := re.search(r"(?:(\d{1,2})(?:st|nd|rd|th)?\s+)?([a-z]{3})[a-z]*\.?,?\s+(?:(\d{1,2})(?:st|nd|rd|th)?,?\s+)?(\d{4})", text)) and m[2] in _MONTHS:
        d, mo, y = m[1] or m[3], str(_MONTHS[m[2]]), m[4]
    elif m := re.search(r"(?<!\d)(\d{4})(?!\d)", text):
        y, mo, d = m[1], None, None
    else:
        return None
    if about:
        mo = d = None
    return _made(int(y), int(mo) if mo else None, int(d) if d else None) or _made(int(y))


_FIELDS = {"nameja": "name", "nameen": "name", "namezh": "name", "primaryname": "name", "name": "name", "birthdate": "date", "birthplace": "place", "debutyear": "debut"}


def pages(observations: DataFrame) -> DataFrame:
    """(`page`, `field`: name, date or place, `value`, `date`, `level`): what each page that isn't linked states on a person.

    Spellings of types and fields are unified: case, separators and a leading path don't matter.
    """
    kind = F.lower(F.trim("entity_type")).isin("person", "people", "persons", "performer")
    rows = observations.where(kind & F.col("entity_id").isNull() & F.col("source_url").isNotNull()).select(F.col("source_url").alias("page"), "field_path", "observed_value").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, path, raw in zip(b["page"], b["field_path"], b["observed_value"], strict=True):
                field = _FIELDS.get(re.sub(r"[^a-z]", "", (path or "").split(".")[-1].lower()))
                if not field or raw is None:
                    continue
                try:
                    value = json.loads(raw)
                except ValueError:
                    value = raw
                if value is None or value == "":
                    continue
                when = read_date(value) if field == "date" else None
                if field == "date" and not when:
                    continue
                out.append((page, field, value if isinstance(value, str) else json.dumps(value), when and when[0], when[1] if when else 0))
            yield pd.DataFrame(out, columns=["page", "field", "value", "date", "level"])

    return rows.mapInPandas(read, "page string, field string, value string, date date, level int")


# --- attributes that two sources may share ---------------------------------------------------------------

#: Expected chance fits above which a link isn't reported.
CHANCE = 0.35
#: Dates that a slip can make of one: a day or ten days off, day and month exchanged.
_SLIPS = [1, -1, 10, -10]
#: How much support from other records of the same entity may raise a link.
SUPPORT = 0.1
_LATIN = "^[ -~]+$"


def partial_forms(p: Parts, stated: bool) -> dict[str, str]:
    """Forms of what is left of a name: one sign of four lost or wrong, or the family name alone.

    `stated` is true for the side that may be incomplete; the other side offers all that could be left of it.
    """
    out: dict[str, str] = {}
    whole = p.first + p.second
    if is_han(whole) and len(whole) == 4:
        out |= {"X" + whole[:i] + "_" + whole[i + 1 :]: "b" for i in range(4)}
    if not stated:
        if is_han(p.first) and p.kind == "full" and p.order == "F":
            out["F" + p.first] = "x"
            out |= {"P" + whole[:i]: "x" for i in range(3, len(whole))}
        return out
    if p.kind == "whole" and is_han(p.first):
        out[("F" if len(p.first) == 2 else "P") + p.first] = "t"
    elif p.kind == "full" and is_han(p.first) and not re.search(r"\w", p.second):
        out["F" + p.first] = "t"
    return out


def _forms(key: str, stated: bool, keep: Broadcast | None):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[str, str, str]] = []
            sounds: list[tuple[str, str, str]] = []
            for k, p, one, two, latin in parts_of(b, key):
                rows += [(k, form, side) for form, side in rewritings(p, one, two).items() if not (stated and side == "x")]
                rows += [(k, form, side) for form, side in partial_forms(p, stated).items()]
                if p.kind == "full" and (latin or not stated) and (parts := slip_parts(p, one, two)):
                    sounds.append((k, *parts))
            slipped = slip_forms(sounds, None if keep is None else keep.value)
            yield pd.concat([kept(rows, key, keep)[[key, "form"]], pd.DataFrame(slipped, columns=[key, "form"])])

    return make


def all_forms(names: DataFrame, key: str, stated: bool, keep: Broadcast | None = None) -> DataFrame:
    """(`key`, `form`) of rewritings, slips and partial forms; short forms only where they are typed or may be met by typed ones. Names may share a form, which comes several times then."""
    return names.mapInPandas(_forms(key, stated, keep), f"{key} string, form string")


def stated_forms(names: DataFrame, page_facts: DataFrame) -> DataFrame:
    """(`page`, `form`, `date`, `level`, `place`): the forms of each page's names beside what else it states.

    The facts are joined to the names, which are far fewer than the forms. A form that several names of a page share comes once or a few times.
    """
    make = _forms("page", True, None)
    facts = ["date", "level", "place"]

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = b.drop_duplicates("page").set_index("page")[facts]
            for forms in make(iter([b])):
                yield forms.drop_duplicates().join(said, on="page")[["page", "form", *facts]]

    known = names.join(page_facts, "page", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return known.mapInPandas(beside, "page string, form string, date date, level int, place string")


def attribute_edges(stated: DataFrame, entity_forms: DataFrame, entities: DataFrame) -> DataFrame:
    """The candidate graph of `stated_forms`, which are read several times: each (`page`, `entity`) once, with what both ends share and how rare it is.

    Names meet by equi-join on the form and, where both state one, the exact date or one a slip away, else the year of
    birth (family names alone only on dates); a side without date meets the bearers of forms that suffice alone, those of other
    forms where both sides state one place. Edges of ends whose dates conflict, and those that even the best agreement leaves above
    CHANCE, are left out, the latter before they are made where a form tells. Of the forms that both ends share that of the fewest bearers counts.
    """
    # wanted: a page without date states the form; open: an entity without date bears it
    asked = stated.groupBy("form").agg(F.max(F.col("date").isNull()).alias("wanted"))
    offered = cut_lineage(entity_forms.join(asked, "form").join(entities, "entity").distinct())
    counts = [F.count("*").alias("bearing"), persons().alias("bearers"), F.max(F.col("year").isNull()).alias("open")]
    df = cut_lineage(offered.groupBy("form").agg(*counts).withColumn("spread", F.col("bearers") - 1 + UNSEEN))
    right = cut_lineage(offered.join(df, "form"))
    left = cut_lineage(stated.join(df.select("form", "bearing", "spread", "open"), "form"))
    e = right.alias("e")
    slips = F.array("date", *[F.date_add("date", n) for n in _SLIPS], F.try_to_date(F.date_format("date", "yyyy-dd-MM"), "yyyy-MM-dd"))
    family = F.col("form").startswith("F")
    # forms of few bearers meet within the year, as do those of many, but by the days that may fit, so that no bucket grows without bound
    keyed = family | (F.col("bearing") > SPLIT)
    exact = left.where("level = 3").where(keyed).withColumn("_key", F.explode(F.array_distinct(F.array_compact(slips))))
    days = e.where("level = 3").where(keyed)
    by_key = exact.alias("p").join(days, (F.col("p.form") == F.col("e.form")) & (F.col("p._key") == F.col("e.date")) & (F.col("p.form").startswith("F") | (F.year("p.date") == F.col("e.year"))))
    # days of forms of few bearers, and dates of which one is coarser than a day, in one join
    placed = F.coalesce(F.col("p_place"), F.lit(1.0))
    coarse = ~family & (F.col("spread") * F.when(F.col("level") == 1, F.col("p_year")).otherwise(F.col("p_year") / 12) * placed <= CHANCE)
    within = right.where("level > 0").withColumn("_day", (F.col("level") == 3) & ~keyed).withColumn("_coarse", coarse).where("_day or _coarse")
    both_days = F.least("p.level", "e.level") == 3
    by_year = left.where("level > 0").alias("p").join(within.alias("e"), (F.col("p.form") == F.col("e.form")) & (F.year("p.date") == F.col("e.year")) & F.when(both_days, F.col("e._day")).otherwise(F.col("e._coarse")))
    by = _date_evidence()

    def edges(joined: DataFrame) -> DataFrame:
        x = joined.select("p.page", "e.entity", by.alias("by"), "e.bearers", "e.p_day", "e.p_year", "e.p_place", F.col("p.place").alias("pp"), F.col("e.place").alias("ep"))
        return x.where("by <> 'conflict'")

    # all else is told by the two ends
    rarest = lambda x: x.groupBy(*[c for c in x.columns if c != "bearers"]).agg(F.min("bearers").alias("bearers"))
    met = cut_lineage(rarest(edges(by_key).unionByName(edges(by_year))))
    return met.unionByName(rarest(edges(_undated_pairs(left, right, same_places(met)))))


def _undated_pairs(left: DataFrame, right: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs `p`, `e` of which one has no date: those of a form that suffices alone, and those that share a form and a place.

    Forms of many are joined in parts. Dated rows take part only with forms that a row without date on the other side has.
    """
    at = cut_lineage(places)
    alone = F.col("spread") <= CHANCE
    last = (F.col("bearing") / SPLIT).cast("int")

    def keyed(x: DataFrame) -> DataFrame:
        named = x.join(at, "place", "left").withColumn("at", F.when(alone, F.lit("")).otherwise(F.coalesce("same", "place")))
        return named.drop("same").where("at is not null")

    asked = keyed(left.where("date is null or open")).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    likely = right.where("year is null or wanted").where(alone | (F.col("spread") * F.col("p_place") <= CHANCE))
    borne = keyed(likely).withColumn("part", F.pmod(F.xxhash64("entity"), last + 1).cast("int"))
    undated = F.col("p.date").isNull() | F.col("e.year").isNull()
    return asked.alias("p").join(borne.alias("e"), (F.col("p.form") == F.col("e.form")) & (F.col("p.at") == F.col("e.at")) & (F.col("p.part") == F.col("e.part")) & undated)


def same_places(edges: DataFrame) -> DataFrame:
    """(`place`, `same`): places of one side with the one that the other side states for the same entities.

    Learned from edges that name and day of birth leave no doubt about. Latin spellings count only as sources.
    """
    sure = edges.where((F.col("by") == "day") & ((F.col("bearers") - 1 + UNSEEN) * F.col("p_day") < 0.02) & F.col("pp").isNotNull() & F.col("ep").isNotNull())
    met = sure.where(~F.col("ep").rlike(_LATIN)).select("page", "entity", "pp", "ep").distinct().groupBy("pp", "ep").agg(F.count("*").alias("n"))
    best = met.groupBy("pp").agg(F.max_by("ep", F.struct("n", "ep")).alias("same"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where("n >= 2 and 2 * n > all").select(F.col("pp").alias("place"), "same")


def weigh(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(`page`, `entity`, `chance`, `weight`): edges weighted by the rarity of what both ends share, places compared by their common names."""
    named = edges
    for c in ("pp", "ep"):
        named = named.join(places.select(F.col("place").alias(c), F.col("same").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    by, pp, ep = F.col("by"), F.col("pp"), F.col("ep")
    dated = F.when(by == "day", F.col("p_day")).when(by == "slip", F.col("p_year") * (6 / 365)).when(by == "month", F.col("p_year") / 12).when(by == "year", F.col("p_year")).otherwise(1.0)
    comparable = pp.isNotNull() & ep.isNotNull() & (pp.rlike(_LATIN) == ep.rlike(_LATIN))
    placed = F.when(comparable & (pp == ep), F.col("p_place")).when(comparable, F.lit(30.0)).otherwise(1.0)
    chance = (F.col("bearers") - 1 + UNSEEN) * dated * placed
    return named.groupBy("page", "entity").agg(F.min(chance).alias("chance")).withColumn("weight", F.greatest(-F.log("chance"), F.lit(0.0)))


def _date_evidence():
    x, y = F.col("p.date"), F.col("e.date")
    low = F.least("p.level", "e.level")
    apart = F.abs(F.datediff(x, y))
    swapped = (F.year(x) == F.year(y)) & (F.month(x) == F.dayofmonth(y)) & (F.dayofmonth(x) == F.month(y))
    by = F.when((low == 0) | x.isNull() | y.isNull(), "none").when((low == 3) & (x == y), "day").when((low == 3) & (apart.isin(1, 10) | swapped), "slip")
    return by.when((low == 2) & (F.trunc(x, "MM") == F.trunc(y, "MM")), "month").when((low == 1) & (F.year(x) == F.year(y)), "year").otherwise("conflict")


def prune(edges: DataFrame) -> DataFrame:
    """Meta-blocking: of each page's edges that exceed chance, those of at least their mean weight."""
    likely = edges.where(F.col("chance") <= CHANCE)
    return likely.withColumn("_mean", F.avg("weight").over(Window.partitionBy("page"))).where(F.col("weight") >= F.col("_mean") - 1e-9).drop("_mean")


def propagate(edges: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Edges with `similarity`: each page's weights as shares, refined by the similarity of the neighbours until stable.

    Pages are neighbours if they share a candidate entity. In each round an entity gathers the similarity of its pages, and
    a page gives more to the entity that its neighbours agree on. It ends when no similarity moves by `tolerance` any more, which it does as
    SUPPORT makes each round a contraction. A page of one candidate has similarity 1 throughout and takes part only by what it lends.
    """
    total = Window.partitionBy("page")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1e-9))
    marked = cut_lineage(edges.withColumn("_n", F.count("*").over(total)).withColumn("similarity", F.when(F.col("_n") == 1, 1.0).otherwise(share("weight"))))
    now = marked.where("_n > 1").drop("_n")
    alone = marked.where("_n = 1").drop("_n")
    lent = cut_lineage(alone.groupBy("entity").agg(F.sum("similarity").alias("similarity")).join(now.select("entity").distinct(), "entity", "left_semi"))
    moved = None if now.isEmpty() else 1.0
    while moved is not None and moved >= tolerance:
        support = now.select("entity", "similarity").unionByName(lent).groupBy("entity").agg(F.log1p(F.sum("similarity")).alias("_support"))
        raised = now.withColumnRenamed("similarity", "_before").join(support, "entity").withColumn("_raw", F.col("weight") * (1 + SUPPORT * F.col("_support")))
        after = cut_lineage(raised.select("page", "entity", "chance", "weight", "_before", share("_raw").alias("similarity")))
        moved = after.agg(F.max(F.abs(F.col("similarity") - F.col("_before")))).first()[0]
        now = after.drop("_before")
    return now.unionByName(alone)


def link(edges: DataFrame) -> DataFrame:
    """(`page`, `entity`, `confidence`): the entity of each page, if one stands out.

    Confidence is the share of the page's similarity times 1 / (1 + expected chance fits). Ties go to the smaller entity.
    """
    refined = propagate(prune(edges))
    order = F.struct(F.round("similarity", 6), -F.col("chance"))
    best = refined.groupBy("page").agg(F.max(order).alias("_o"))
    top = refined.join(best, "page").where(order == F.col("_o"))
    return top.groupBy("page").agg(F.min(F.struct("entity", "similarity", "chance")).alias("b")).select("page", "b.entity", (F.col("b.similarity") / (1 + F.col("b.chance"))).alias("confidence"))
