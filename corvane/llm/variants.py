"""Linking the spellings under which one person stands in several records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import connected
from corvane.llm.filters import BITS, filter_of, passes, text_hashes
from corvane.llm.names import Parts, clean, deletions, is_han, kana_to_latin, letters, parse, reading, remains
from corvane.session import cut_lineage

#: Expected number of other entities that fit as well by chance, above which a shared rewriting doesn't link.
CHANCE = 0.4
#: Chance fits that a name met once may have in entities not in the data.
UNSEEN = 0.3
#: Bearers of one form that one task joins where a date is missing; forms of more are joined in parts.
SPLIT = 500
#: How much rarer a wrong sign in a name is than another spelling of it: what the expected chance fits of such forms are multiplied by.
WRONG_SIGN = 20.0
#: The same for each slip of a letter after the first.
SECOND_SLIP = 4.0
#: Pairs of remains of two parts that are compared with a filter at a time.
SLIPS_AT_ONCE = 1 << 18
#: Factor for places that conflict.
OTHER_PLACE = 30.0

#: A given name in kana of at most so many signs may also be the beginning of a longer one.
PET_SIGNS = 3

_LATIN = "^[ -~]+$"

# --- normal characters and readings, learned from the table itself ---------------------------------


def character_forms(pairs: DataFrame, own: str, other: str) -> dict[str, str]:
    """Characters of `other` (names in another script form) with the character of `own` that stands in the same place.

    Learned from names of equal length. A character is replaced only if it does so more often than it
    occurs in `own` itself. The result is bounded by the number of Han characters in Unicode, so it comes to the driver.
    """
    same = pairs.select(F.col(own).alias("o"), F.col(other).alias("x")).where("o is not null and x is not null and length(o) = length(x)")
    letters = same.select(F.explode(F.arrays_zip(F.split("o", "").alias("o"), F.split("x", "").alias("x"))).alias("z")).select("z.o", "z.x")
    native = letters.groupBy(F.col("o").alias("x")).agg(F.count("*").alias("own_n"))
    moved = letters.where("o <> x and o rlike '^\\\\p{IsHan}$' and x rlike '^\\\\p{IsHan}$'").groupBy("x", "o").agg(F.count("*").alias("n"))
    best = moved.groupBy("x").agg(F.max_by("o", F.struct("n", "o")).alias("o"), F.max("n").alias("n")).join(native, "x", "left").where("n > coalesce(own_n, 0)")
    return {r["x"]: r["o"] for r in best.select("x", "o").collect()}


def _names_schema(key: str) -> str:
    return f"{key} string, kind string, first string, second string, order string, latin boolean"


def typed_names(rows: DataFrame, key: str, name: str, forms: dict[str, str]) -> DataFrame:
    """The parts of each typed name (see names.Parts), its characters brought to one form. Names without parts give no row."""
    table = rows.sparkSession.sparkContext.broadcast(str.maketrans(forms))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n in zip(b[key], b[name], strict=True):
                p = parse(clean(n).translate(table.value))
                if p:
                    out.append((k, p.kind, p.first, p.second, p.order, p.first.isascii() and p.second.isascii()))
            yield pd.DataFrame(out, columns=["k", "kind", "first", "second", "order", "latin"]).rename(columns={"k": key})

    return rows.select(key, name).where(F.col(name).isNotNull()).mapInPandas(split, _names_schema(key))


def reading_dictionary(names: DataFrame, key: str) -> DataFrame:
    """(`part`, `as_family`, `as_given`): how parts in Han characters are read, learned from records that state a name both ways.

    `names` are the typed names of each record, those split by a blank included. The commonest reading counts; a role in
    which a part is met in less than a quarter of its names, as by names typed in reverse, is left out.
    """
    full = names.where("kind = 'full'")
    han = full.where("first rlike '^\\\\p{IsHan}+$' and second rlike '^\\\\p{IsHan}+$' and order in ('F', '?')").select(F.col(key), F.col("first").alias("f"), F.col("second").alias("g")).distinct()
    heard = full.where("latin").select(F.col(key).alias("_k"), F.when(F.col("order") == "G", F.col("second")).otherwise(F.col("first")).alias("rf"), F.when(F.col("order") == "G", F.col("first")).otherwise(F.col("second")).alias("rg")).distinct()
    both = han.join(heard, han[key] == heard["_k"])
    entries = both.select(F.explode(F.array(F.struct(F.col("f").alias("part"), F.lit("F").alias("role"), F.lower("rf").alias("r")), F.struct(F.col("g").alias("part"), F.lit("G").alias("role"), F.lower("rg").alias("r")))).alias("e")).select("e.*")
    best = entries.groupBy("part", "role", "r").agg(F.count("*").alias("n")).groupBy("part", "role").agg(F.max_by("r", F.struct("n", "r")).alias("r"), F.sum("n").alias("n"))
    role = lambda x, c: F.max(F.when(F.col("role") == x, F.col(c)))
    roles = best.groupBy("part").agg(role("F", "r").alias("f"), role("G", "r").alias("g"), F.coalesce(role("F", "n"), F.lit(0)).alias("nf"), F.coalesce(role("G", "n"), F.lit(0)).alias("ng"))
    return roles.select("part", F.when(F.col("nf") * 3 >= F.col("ng"), F.col("f")).alias("as_family"), F.when(F.col("ng") * 3 >= F.col("nf"), F.col("g")).alias("as_given"))


def with_readings(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Typed names with the readings of their Han parts in either role; NULL where unknown or not in Han.

    An unspaced Han name whose parts aren't known that way comes also with each split, in either order, of which the dictionary knows both parts.
    """
    one = dictionary.select(F.col("part").alias("first"), F.col("as_family").alias("first_f"), F.col("as_given").alias("first_g"))
    two = dictionary.select(F.col("part").alias("second"), F.col("as_family").alias("second_f"), F.col("as_given").alias("second_g"))
    read = cut_lineage(names.join(one, "first", "left").join(two, "second", "left"))
    text = F.concat("first", "second")
    odd = read.where(text.rlike("^\\p{IsHan}{2,6}$") & (F.col("order") == "F") & F.col("kind").isin("full", "whole") & (F.col("first_f").isNull() | F.col("second_g").isNull()))
    at = odd.select(*[c for c in names.columns if c not in ("kind", "first", "second", "order")], text.alias("_t"), F.length("first").alias("_n"), F.explode(F.sequence(F.lit(1), F.length(text) - 1)).alias("_i"))
    cut = at.select("*", F.lit("full").alias("kind"), F.expr("substring(_t, 1, _i)").alias("first"), F.expr("substring(_t, _i + 1)").alias("second")).join(one, "first").join(two, "second")
    forward = F.when((F.col("_i") != F.col("_n")) & F.col("first_f").isNotNull() & F.col("second_g").isNotNull(), F.lit("F"))
    reverse = F.when(F.col("first_g").isNotNull() & F.col("second_f").isNotNull(), F.lit("G"))
    return read.unionByName(cut.withColumn("order", F.explode(F.array_compact(F.array(forward, reverse)))).select(*read.columns))


# --- canonical rewritings ----------------------------------------------------------------------------


def _sound(part: str, known: str | None) -> str | None:
    return known if is_han(part) else kana_to_latin(part)


def rewritings(p: Parts, first: tuple[str | None, str | None], second: tuple[str | None, str | None], given: bool = False, part: bool = False) -> dict[str, str]:
    """Every canonical form of a name, with its side: b meets all, t (typed short) meets t and x (expansion of a full name).

    first, second: readings of the parts as family and as given name. With `given`, forms of the given name alone as well;
    `part` tells that a name of one word is known as a part of names, so that it isn't a full name written without blank.
    """
    out: dict[str, str] = {}
    if p.kind == "whole":
        if not is_han(p.first):
            r = reading(p.first)
            if len(r) >= 4 and not part:
                out["R" + r] = "b"
            if given and len(r) >= 2:
                out["G" + r] = "t"
        if not part:
            out["H" + p.first.lower()] = "b"
        return out
    if p.kind == "pet":
        f, g = _sound(p.first, first[0]), reading(p.second)
        if not p.first:
            return {"Q" + g: "t"} if given and len(g) >= 2 else {}
        if f and g:
            out[f"N{reading(f)}|{g}"] = "t"
        if is_han(p.second) and second[1]:
            out[f"N{reading(f or '')}|{reading(second[1])}"] = "t"
        return out
    if p.kind == "initial":
        f, g = _sound(p.first, first[0]), _sound(p.first, first[1])
        if f:
            out[f"I{reading(f)}|{p.second}"] = "t"
        if g and p.order == "?":
            out[f"J{reading(g)}|{p.second}"] = "t"
        return out
    pairs = []
    if p.order in "F?":
        pairs.append((p.first, p.second, _sound(p.first, first[0]), _sound(p.second, second[1])))
    if p.order in "G?":
        pairs.append((p.second, p.first, _sound(p.second, second[0]), _sound(p.first, first[1])))
    for f, g, rf, rg in pairs:
        if is_han(f) and is_han(g):
            out["H" + f + g] = "b"
        if not rf or not rg:
            continue
        a, b = reading(rf), reading(rg)
        if not a or not b:
            continue
        out["R" + reading(rf + rg)] = "b"
        if not g.isascii() and not is_han(g) and len(g) <= PET_SIGNS:
            out[f"N{a}|{b}"] = "t"
        if p.first.isascii() and p.second.isascii():
            out.setdefault("R" + reading(rg + rf), "b")
        out[f"I{a}|{b[0]}"] = out[f"J{b}|{a[0]}"] = "x"
        if given:
            out["G" + b] = "x"
        for n in range(2, len(b) + 1):
            out.setdefault(f"N{a}|{b[:n]}", "x")
            if given:
                out["Q" + b[:n]] = "x"
    return out


@lru_cache(maxsize=100_000)
def _deleted(word: str) -> tuple[list[str], np.ndarray]:
    each = sorted(deletions(word))
    return each, text_hashes(each)


def _joint(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash for two, in either order."""
    return (x ^ y) * np.uint64(0x9E3779B97F4A7C15) + x + y


def form_hashes(forms: list[str]) -> np.ndarray:
    """The hash by which the filter knows a form; that of a slip form is made of its two parts' hashes."""
    out = text_hashes(forms)
    two = [i for i, f in enumerate(forms) if f.startswith("D")]
    if two:
        parts = text_hashes([p for i in two for p in forms[i][1:].split("|", 1)])
        out[two] = _joint(parts[0::2], parts[1::2])
    return out


def slip_parts(p: Parts, first: tuple[str | None, str | None], second: tuple[str | None, str | None]) -> tuple[str, str] | None:
    """The sounds of both parts of a full name in which slips are looked for."""
    f, g = (p.first, p.second) if p.order != "G" else (p.second, p.first)
    rf, rg = (_sound(f, first[0]), _sound(g, second[1])) if p.order != "G" else (_sound(f, second[0]), _sound(g, first[1]))
    if not rf or not rg:
        return None
    a, b = reading(rf), reading(rg)
    return None if len(a) < 3 or len(b) < 2 else (a, b)


def slips(p: Parts, first: tuple[str | None, str | None], second: tuple[str | None, str | None], keep: np.ndarray | None = None) -> list[str]:
    """Forms that a full name shares with another whose parts are each at most one slip of a letter away, in either order."""
    parts = slip_parts(p, first, second)
    return [form for _, form in slip_forms([("", *parts)], keep)] if parts else []


def slip_forms(names: list[tuple[str, str, str]], keep: np.ndarray | None = None) -> list[tuple[str, str]]:
    """(key, form) of slips from (key, sound, sound) of full names, all of them or those that may be wanted, which are sought for many names at once."""
    out: list[tuple[str, str]] = []
    if keep is None:
        for k, a, b in names:
            out += [(k, f"D{x}|{y}" if x <= y else f"D{y}|{x}") for x in _deleted(a)[0] for y in _deleted(b)[0]]
        return out
    begin = 0
    while begin < len(names):
        end, size = begin, 0
        while end < len(names) and (end == begin or size < SLIPS_AT_ONCE):
            size += (len(names[end][1]) + 1) * (len(names[end][2]) + 1)
            end += 1
        some = names[begin:end]
        one, two = [_deleted(a) for _, a, _ in some], [_deleted(b) for _, _, b in some]
        na, nb = np.array([len(x) for x, _ in one]), np.array([len(y) for y, _ in two])
        # places of the first and of the second part's remains, for each pair of them within each name
        i = np.repeat(np.arange(na.sum()), np.repeat(nb, na))
        owner = np.repeat(np.arange(len(some)), na * nb)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        j = (np.cumsum(nb) - nb)[owner] + within % nb[owner]
        hit = np.flatnonzero(passes(keep, _joint(np.concatenate([h for _, h in one])[i], np.concatenate([h for _, h in two])[j])))
        first = i - (np.cumsum(na) - na)[owner]
        for n, x, y in zip(owner[hit].tolist(), first[hit].tolist(), (within % nb[owner])[hit].tolist(), strict=True):
            out.append((some[n][0], "D" + "|".join(sorted((one[n][0][x], two[n][0][y])))))
        begin = end
    return out


def kept(rows: list[tuple[str, str, str]], key: str, keep: Broadcast | None) -> pd.DataFrame:
    """Rows (key, form, side) whose forms may be wanted."""
    if keep is not None and rows:
        wanted = passes(keep.value, form_hashes([r[1] for r in rows]))
        rows = [r for r, w in zip(rows, wanted.tolist(), strict=True) if w]
    return pd.DataFrame(rows, columns=[key, "form", "side"])


def parts_of(b: pd.DataFrame, key: str) -> Iterator[tuple[str, Parts, tuple[str | None, str | None], tuple[str | None, str | None], bool]]:
    """(key, parts, readings of the first part, of the second, whether in Latin letters) of each typed name of a batch."""
    columns = ("kind", "first", "second", "order", "first_f", "first_g", "second_f", "second_g", "latin")
    none = lambda x: None if x is None or x != x else x
    for k, kind, f, s, o, ff, fg, sf, sg, latin in zip(b[key], *[b[c] for c in columns], strict=True):
        yield k, Parts(kind, f, s, o), (none(ff), none(fg)), (none(sf), none(sg)), bool(latin)


def lexicon(dictionary: DataFrame) -> DataFrame:
    """(`role`, `sound`): the readings that the dictionary knows of family (F) and given names (G)."""

    def sounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(role, reading(r)) for role, c in (("F", "as_family"), ("G", "as_given")) for r in b[c] if r], columns=["role", "sound"])

    return dictionary.mapInPandas(sounds, "role string, sound string").distinct()


def typed_sounds(names: DataFrame) -> DataFrame:
    """Names that aren't in Han with the sounds of their parts (`one`, `two`)."""

    def sounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(one=[reading(x) for x in b["first"]], two=[reading(x) for x in b["second"]])

    return names.where("kind in ('full', 'whole') and not first rlike '\\\\p{IsHan}' and not second rlike '\\\\p{IsHan}'").select("first", "second").distinct().mapInPandas(sounds, "first string, second string, one string, two string")


def in_dictionary(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(`first`, `second`, `known`) of names in letters or kana: whether the dictionary knows all their parts in their roles, in either order; names of one part in any role."""
    known = lexicon(dictionary).groupBy("sound").agg(F.max(F.col("role") == "F").alias("f"), F.max(F.col("role") == "G").alias("g"))
    each = typed_sounds(names)
    for part in ("one", "two"):
        each = each.join(known.select(F.col("sound").alias(part), F.col("f").alias(f"{part}_f"), F.col("g").alias(f"{part}_g")), part, "left")
    both = (F.col("one_f") & F.col("two_g")) | (F.col("one_g") & F.col("two_f")) | ((F.col("two") == "") & F.col("one_f").isNotNull())
    return each.select("first", "second", F.coalesce(both, F.lit(False)).alias("known"))


@lru_cache(maxsize=100_000)
def _left(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what remains of a word, and the number of letters left out."""
    left = remains(word)
    return text_hashes(list(left)), np.fromiter(left.values(), np.int8, len(left))


def slip_hashes(p: Parts, first: tuple[str | None, str | None], second: tuple[str | None, str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a full name shares with another of at most two slips, and how many letters each leaves out.

    The parts may stand in either order. Both the letters as typed and their reading are taken, as a slip may break a rule of romanisation.
    """
    f, g, one, two = (p.second, p.first, second, first) if p.order == "G" else (p.first, p.second, first, second)
    rf, rg = _sound(f, one[0]), _sound(g, two[1])
    if not rf or not rg:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    hashes, counts = [], []
    for a, b in {(letters(rf), letters(rg)), (reading(rf), reading(rg))}:
        (hx, nx), (hy, ny) = _left(a), _left(b)
        n = nx[:, None] + ny[None, :]
        few = n <= 2
        hashes.append(_joint(hx[:, None], hy[None, :])[few])
        counts.append(n[few])
    return np.concatenate(hashes), np.concatenate(counts)


def wrong_sign(p: Parts) -> list[str]:
    """Forms that an unspaced name of four Han characters shares with one of which a single character differs."""
    whole = p.first + p.second if p.order != "G" else p.second + p.first
    return [f"X{whole[:i]}_{whole[i + 1 :]}" for i in range(4)] if len(whole) == 4 and is_han(whole) else []


_FORMS = "entity string, h long, kind string, side string, slips int, name long"


def _stated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list[tuple[str, str, str, None]] = []
        keys, hashes, left = [], [], []
        for (k, p, one, two, _), short, known in zip(parts_of(b, "entity"), b["short"], b["known"], strict=True):
            rows += [(k, form, side, None) for form, side in rewritings(p, one, two, True, bool(known)).items() if side == "b" or (side == "t" and (short or p.kind == "full"))]
            rows += [(k, form, "b", None) for form in wrong_sign(p)]
            if p.kind == "full" and known is not None and not known:
                h, n = slip_hashes(p, one, two)
                keys += [k] * len(h)
                hashes.append(h)
                left.append(n)
        yield _frame(rows)
        if keys:
            yield _slip_frame(keys, np.concatenate(hashes), "t", np.concatenate(left), None)


def _frame(rows: list[tuple[str, str, str, str | None]]) -> pd.DataFrame:
    hashes = text_hashes([r[1] for r in rows]).view(np.int64)
    names = np.where([r[3] is None for r in rows], 0, text_hashes([r[3] or "" for r in rows]).view(np.int64))
    return pd.DataFrame({"entity": [r[0] for r in rows], "h": hashes, "kind": [r[1][0] for r in rows], "side": [r[2] for r in rows], "slips": np.zeros(len(rows), np.int32), "name": names.astype(np.int64)})


def _slip_frame(keys: object, hashes: np.ndarray, side: str, left: np.ndarray, names: np.ndarray | None) -> pd.DataFrame:
    name = np.zeros(len(hashes), np.int64) if names is None else names.view(np.int64)
    return pd.DataFrame({"entity": keys, "h": hashes.view(np.int64), "kind": "D", "side": side, "slips": left.astype(np.int32), "name": name})


def _offered(keep: Broadcast):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[str, str, str, str]] = []
            keys: list[str] = []
            sounds: list[str] = []
            hashes, left, owners = [], [], []
            for (k, p, one, two, _), known in zip(parts_of(b, "entity"), b["known"], strict=True):
                forms = rewritings(p, one, two, True)
                sound = next((form for form in forms if form[0] == "R"), None)
                if sound is None:
                    continue
                rows += [(k, form, "x", sound) for form, side in forms.items() if side == "x"]
                if known is None or known:
                    h, n = slip_hashes(p, one, two)
                    hashes.append(h)
                    left.append(n)
                    owners.append(np.full(len(h), len(keys)))
                    keys.append(k)
                    sounds.append(sound)
            frame = _frame(rows)
            yield frame[passes(keep.value, frame["h"].to_numpy().view(np.uint64))]
            if keys:
                h = np.concatenate(hashes)
                wanted = passes(keep.value, h)
                who = np.concatenate(owners)[wanted]
                yield _slip_frame(np.array(keys, object)[who], h[wanted], "x", np.concatenate(left)[wanted], text_hashes(sounds)[who])

    return make


def entity_forms(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(`entity`, `h`: the hash of a form, `kind`, `side`, `slips`, `name`: the full name it may be short for) of all names of the entities, each form of an entity once.

    Forms are known by 64-bit hashes only: a chance collision would also have to agree in date or place to link. Short forms
    are asked for only by entities that state no full name, slip forms only by names that the
    dictionary doesn't know; expansions and slips of other names are made only where something may ask for them.
    """
    full = names.where("kind = 'full'").select("entity").distinct().withColumn("_full", F.lit(True))
    marked = names.join(full, "entity", "left").join(in_dictionary(names, dictionary), ["first", "second"], "left")
    marked = cut_lineage(marked.withColumn("short", F.col("_full").isNull()).drop("_full"))
    stated = cut_lineage(marked.mapInPandas(_stated, _FORMS))
    asked = filter_of(stated.where("side = 't'").select(F.pmod("h", F.lit(BITS)).alias("bit")))
    offered = marked.where("kind = 'full'").mapInPandas(_offered(asked), _FORMS)
    each = stated.unionByName(offered).groupBy("entity", "h", "kind").agg(F.max("side").alias("_high"), F.min("side").alias("_low"), F.min("slips").alias("slips"), F.max(F.nullif("name", F.lit(0))).alias("name"))
    return each.select("entity", "h", "kind", F.when(F.col("_low") == "b", "b").when(F.col("_low") == "t", "t").otherwise("x").alias("side"), "slips", "name")


# --- evidence besides the name ------------------------------------------------------------------------


def date_level(date: Column, precision: Column) -> Column:
    """3 day, 2 month, 1 year, 0 unknown. A first of the month, or of January, may stand for less than is claimed."""
    claimed = F.lower(F.trim(precision))
    level = F.when(claimed == "year", 1).when(claimed == "month", 2).otherwise(3)
    shown = F.when((F.month(date) == 1) & (F.dayofmonth(date) == 1), 1).when(F.dayofmonth(date) == 1, 2).otherwise(3)
    return F.when(date.isNull(), 0).otherwise(F.least(level, shown))


def dates_agree(a: str, b: str) -> Column:
    """The level to which two (`date`, `level`) agree: 0 if either is unknown, -1 if they conflict."""
    level = F.least(f"{a}.level", f"{b}.level")
    x, y = F.col(f"{a}.date"), F.col(f"{b}.date")
    return F.when(level == 0, 0).when((level == 3) & (x == y), 3).when((level == 2) & (F.trunc(x, "MM") == F.trunc(y, "MM")), 2).when((level == 1) & (F.year(x) == F.year(y)), 1).otherwise(-1)


def place_key(place: Column, forms: dict[str, str]) -> Column:
    """A place without case, blanks and what follows the name proper."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(place, r"(?U)\s+", "")), "(出身|出生|生まれ)$", "")
    mapped = F.translate(bare, "".join(forms), "".join(forms.values())) if forms else bare
    return F.nullif(F.regexp_replace(mapped, "(?<=..)(市|町|村|区|郡|-shi|-machi|-mura)$", ""), F.lit(""))


def place_names(stated: DataFrame, owner: str, place: str) -> DataFrame:
    """(`place`, `same`): Latin place keys with the native one that the same owners state most often."""
    each = stated.select(owner, place).where(F.col(place).isNotNull()).distinct()
    latin = each.where(F.col(place).rlike("^[ -~]+$")).select(F.col(owner), F.col(place).alias("place"))
    native = each.where(~F.col(place).rlike("^[ -~]+$")).select(F.col(owner), F.col(place).alias("same"))
    met = latin.join(native, owner).groupBy("place", "same").agg(F.count("*").alias("n"))
    return met.groupBy("place").agg(F.max_by("same", F.struct("n", "same")).alias("same"))


def with_rates(entities: DataFrame) -> DataFrame:
    """Entities (`entity`, `date`, `level`, `place`) with the share of entities that have the same day, year and place.

    Counts by calendar day and year are bounded by the calendar; those by place are joined.
    """
    n = F.lit(max(entities.count(), 1))
    day = entities.where("level = 3").groupBy("date").agg(F.count("*").alias("_nd"))
    year = entities.where("level > 0").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("_ny"))
    place = entities.where("place is not null").groupBy("place").agg(F.count("*").alias("_np"))
    e = entities.withColumn("year", F.when(F.col("level") > 0, F.year("date")))
    e = e.join(F.broadcast(day), "date", "left").join(F.broadcast(year), "year", "left").join(place, "place", "left")
    rate = lambda c: F.coalesce(F.col(c), F.lit(1)) / n
    return e.select("entity", "date", "level", "year", "place", rate("_nd").alias("p_day"), rate("_ny").alias("p_year"), rate("_np").alias("p_place"))


def persons() -> Column:
    """How many persons at least bear a form, as an aggregate over its entities: those born on different days, or without date in different places.

    Entities born in one year may be one person unless their days differ. The sets are bounded by the calendar and the number of places.
    """
    years, days = F.collect_set("year"), F.collect_set(F.when(F.col("level") == 3, F.col("date")))
    born = F.size(days) + F.size(F.array_except(years, F.transform(days, F.year)))
    return F.greatest(born, F.size(F.collect_set(F.when(F.col("level") == 0, F.col("place")))), F.lit(1))


def place_classes(met: DataFrame) -> DataFrame:
    """(`place`, `same`): places with the one by which they are known, learned from pairs of one person (`pa`, `pb`).

    A place in Latin letters stands for the native one, another for the commoner one that it is paired with; the pair must be
    met twice and outweigh all others of the place.
    """
    both = met.where("pa is not null and pb is not null")
    sides = both.select(F.col("pa").alias("place"), F.col("pb").alias("same")).unionByName(both.select(F.col("pb").alias("place"), F.col("pa").alias("same")))
    n = sides.groupBy("place", "same").agg(F.count("*").alias("n"))
    common = n.groupBy("place").agg(F.sum("n").alias("c"))
    pairs = n.where("place <> same").join(common, "place").join(common.select(F.col("place").alias("same"), F.col("c").alias("d")), "same")
    latin = lambda c: F.col(c).rlike(_LATIN)
    upward = (latin("place") & ~latin("same")) | ((latin("place") == latin("same")) & (F.struct("d", "same") > F.struct("c", "place")))
    best = pairs.groupBy("place").agg(F.max(F.when(upward, F.struct("n", "same"))).alias("b"), F.sum("n").alias("all"))
    known = cut_lineage(best.where("b.n >= 2 and 2 * b.n > all").select("place", F.col("b.same").alias("same")))
    further = known.select(F.col("place").alias("same"), F.col("same").alias("_next"))
    return known.join(further, "same", "left").select("place", F.coalesce("_next", "same").alias("same"))


def _spread(near: float) -> Column:
    """Persons expected to bear a form besides the one at hand, times how much rarer its kind of slip is than a spelling by rule.

    Nearly every name has neighbours of which one sign differs; their mean number `near` counts where fewer are known for a form.
    """
    others = F.greatest(F.col("bearers") - 1, F.lit(0)) + UNSEEN
    wrong = F.greatest(F.col("bearers") - 1, F.lit(near)) * WRONG_SIGN + UNSEEN
    return F.when(F.col("kind") == "X", wrong).when(F.col("slips") > 1, others * SECOND_SLIP).otherwise(others)


def candidates(forms: DataFrame, entities: DataFrame) -> DataFrame:
    """(`a`, `b`, `chance`, `agreed`) of entities that share a form, don't conflict in date, and fit better than CHANCE.

    chance: the persons expected to fit as well, which is those that bear the form besides times the share that agrees in date and place.
    Equi-joins on the form and what both state: the day, else the year; where one has no date the place, unless the form
    alone suffices. Bearers for which even the best agreement leaves more than CHANCE don't take part, so forms of many persons make no
    pairs that the threshold excludes.
    """
    known = cut_lineage(forms.join(entities, "entity"))
    shared = known.groupBy("h").agg(F.count("*").alias("entities"), F.greatest(persons(), F.approx_count_distinct("name")).alias("bearers"), F.max("side").alias("_high"), F.min("side").alias("_low")).where("entities > 1 and not (_high = 'x' and _low = 'x')").drop("_high", "_low")
    full = cut_lineage(known.join(shared, "h"))
    n = full.where("kind = 'X'").agg(F.sum(F.col("bearers") - 1).alias("n"), F.count_distinct("entity").alias("all")).first()
    spread = _spread(float((n["n"] or 0) / max(n["all"], 1)))
    full = full.withColumn("spread", spread)
    placed = F.coalesce(F.col("p_place"), F.lit(1.0))
    dates = {"day": F.col("p_day"), "year": F.when(F.col("level") == 1, F.col("p_year")).otherwise(F.col("p_year") / 12)}
    columns = ["h", "side", "slips", "spread", "entity", "date", "level", "year", "place", "p_day", "p_year", "p_place"]

    def sides(x: DataFrame, y: DataFrame, meets: Column) -> DataFrame:
        return x.alias("a").join(y.alias("b"), (F.col("a.h") == F.col("b.h")) & ~((F.col("a.side") == "x") & (F.col("b.side") == "x")) & meets)

    def pairs(x: DataFrame, agreed: Column) -> DataFrame:
        first, second = F.least("a.entity", "b.entity"), F.greatest("a.entity", "b.entity")
        swap = F.col("a.entity") > F.col("b.entity")
        spread = F.greatest("a.spread", "b.spread")
        worst = [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in ("p_day", "p_year", "p_place")]
        places = [F.when(swap, F.col("b.place")).otherwise(F.col("a.place")).alias("pa"), F.when(swap, F.col("a.place")).otherwise(F.col("b.place")).alias("pb")]
        return x.select(first.alias("a"), second.alias("b"), spread.alias("spread"), *worst, *places, agreed.alias("agreed")).where("agreed >= 0")

    day = full.where((F.col("level") == 3) & (F.col("spread") * dates["day"] * placed <= CHANCE)).select(*columns)
    by_day = cut_lineage(pairs(sides(day, day, (F.col("a.date") == F.col("b.date")) & (F.col("a.entity") < F.col("b.entity"))), F.lit(3)))
    same = cut_lineage(place_classes(by_day.where(F.col("spread") * F.col("p_day") < 0.02).groupBy("a", "b").agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"))))
    year = full.where((F.col("level") > 0) & (F.col("spread") * F.least(dates["year"], F.when(F.col("level") == 3, F.col("p_year") / 12).otherwise(1.0)) * placed <= CHANCE)).select(*columns)
    coarse = year.where("level < 3")
    by_year = pairs(sides(coarse, year, (F.col("a.year") == F.col("b.year")) & ((F.col("b.level") == 3) | (F.col("a.entity") < F.col("b.entity")))), dates_agree("a", "b"))
    undated = undated_pairs(full.where("kind <> 'X'").select(*columns, "entities"), same, sides)
    return scored(by_day.unionByName(by_year).unionByName(pairs(undated, F.lit(0))), same)


def undated_pairs(full: DataFrame, same: DataFrame, sides: Callable[[DataFrame, DataFrame, Column], DataFrame]) -> DataFrame:
    """Pairs `a`, `b` of which `a` has no date, or neither has: all that the threshold lets pass.

    A form that suffices alone links whatever the places are; another only bearers of one place, which is part of the
    equi-join then. Forms of many entities are joined in parts.
    """
    alone = F.col("spread") <= CHANCE
    named = full.join(same, "place", "left").withColumn("at", F.when(alone, F.lit("")).otherwise(F.coalesce("same", "place"))).drop("same")
    keyed = named.where(F.col("at").isNotNull() & (alone | (F.col("spread") * F.col("p_place") <= CHANCE)))
    parts = (F.col("entities") / SPLIT).cast("int") + 1
    a = keyed.where("year is null").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    b = keyed.withColumn("part", F.pmod(F.xxhash64("entity"), parts).cast("int"))
    ordered = F.when(F.col("b.year").isNull(), F.col("a.entity") < F.col("b.entity")).otherwise(F.col("a.entity") != F.col("b.entity"))
    return sides(a, b, (F.col("a.at") == F.col("b.at")) & (F.col("a.part") == F.col("b.part")) & ordered)


def scored(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """Pairs with their `chance`, places compared by their common names, each pair once."""
    named = pairs
    for c in ("pa", "pb"):
        named = named.join(same.select(F.col("place").alias(c), F.col("same").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    agreed, x, y = F.col("agreed"), F.col("pa"), F.col("pb")
    dated = F.when(agreed == 3, F.col("p_day")).when(agreed == 2, F.col("p_year") / 12).when(agreed == 1, F.col("p_year")).otherwise(1.0)
    comparable = x.isNotNull() & y.isNotNull() & (x.rlike(_LATIN) == y.rlike(_LATIN))
    placed = F.when(comparable & (x == y), F.col("p_place")).when(comparable, F.lit(OTHER_PLACE)).otherwise(1.0)
    each = named.groupBy("a", "b").agg(F.min(F.col("spread") * dated * placed).alias("chance"), F.max("agreed").alias("agreed"))
    return each.where(F.col("chance") <= CHANCE)


def resolve(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(`entity`, `group`) in which no two members conflict in date.

    Links are taken by the exactness of the date. Those with a day link among themselves, which is transitive;
    then those with a month, a year and without date each join the one group that fits best, or link among themselves where no group fits.
    One that fits two groups about equally well joins neither.
    """
    level = entities.select("entity", "level")
    both = links.select(F.col("a").alias("entity"), F.col("b").alias("other"), "chance").unionByName(links.select(F.col("b").alias("entity"), F.col("a").alias("other"), "chance"))
    edges = cut_lineage(both.join(level, "entity").join(level.select(F.col("entity").alias("other"), F.col("level").alias("other_level")), "other"))
    days = edges.where("level = 3").select("entity").distinct()
    found = connected(edges.where("level = 3 and other_level = 3").select(F.col("entity").alias("a"), F.col("other").alias("b")))
    groups = cut_lineage(days.join(found, "entity", "left").select("entity", F.coalesce("group", "entity").alias("group")))
    for now in (2, 1, 0):
        mine = edges.where(F.col("level") == now)
        groups = cut_lineage(groups.unionByName(_joining(mine.where(F.col("other_level") > now), groups)))
        if now == 0:
            free = mine.where("other_level = 0").join(groups, "entity", "left_anti")
            groups = cut_lineage(groups.unionByName(_joining(free, groups)))
        rest = cut_lineage(mine.select("entity").distinct().join(groups, "entity", "left_anti"))
        among = mine.where(F.col("other_level") == now).join(rest, "entity", "left_semi").join(rest.select(F.col("entity").alias("other")), "other", "left_semi")
        found = connected(among.select(F.col("entity").alias("a"), F.col("other").alias("b")))
        groups = groups.unionByName(rest.join(found, "entity", "left").select("entity", F.coalesce("group", "entity").alias("group")))
    several = groups.groupBy("group").agg(F.min("entity").alias("_lo"), F.max("entity").alias("_hi")).where("_lo <> _hi").select("group")
    return groups.join(several, "group", "left_semi").select("entity", "group")


def _joining(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(`entity`, `group`): the group that fits each entity best by its links; none where the next best fits half as well or better."""
    fits = edges.join(groups.withColumnRenamed("entity", "other"), "other").groupBy("entity", "group").agg(F.min("chance").alias("chance"))
    order = Window.partitionBy("entity").orderBy("chance", "group")
    ranked = fits.withColumn("_next", F.lead("chance").over(order)).withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1 and (_next is null or _next >= 2 * chance)").select("entity", "group")


def variant_groups(names: DataFrame, dictionary: DataFrame, entities: DataFrame) -> DataFrame:
    """(`entity`, `group`): entities linked by shared forms of their names; those without link are missing.

    names: (`entity` and typed parts with readings), with the dictionary that the readings come from. Empty tables give no rows.
    """
    known = cut_lineage(with_rates(entities))
    return resolve(candidates(entity_forms(names, dictionary), known), known)
