"""One form for text that looks the same but consists of different characters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and signs that have the shape of the letter before the colon.
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "ΝՆ",
    "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іı", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хх", "y": "уγ",
    "力": "カ", "口": "ロ", "二": "ニ", "工": "エ", "卜": "ト", "夕": "タ", "八": "ハ", "一": "ー", "才": "オ", "千": "チ", "三": "ミ", "丿": "ノ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ",
}
#: Horizontal strokes of one line, and the minus.
_DASHES = "‐‑‒–—―⁃−﹘﹣－"
#: Characters without ink that aren't blanks: fillers, joiners, marks of direction, variation selectors.
_INKLESS = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0100, 0xE01F0)]


def _character_maps() -> tuple[dict[str, str], dict[str, str], str]:
    """What each character becomes in readable text, what the readable ones become by shape, and the characters that are removed."""
    plain: dict[str, str] = {}
    for code in [*range(0x2E80, 0x2FE0), *range(0xFF01, 0xFFEF), *range(0x3131, 0x318F)]:
        whole = unicodedata.normalize("NFKC", chr(code))  # widths and radicals that stand for the sign itself
        if len(whole) == 1 and whole != chr(code):
            plain[chr(code)] = whole
    plain["ﾞ"], plain["ﾟ"] = "\u3099", "\u309a"
    for code in range(0x10000):
        if unicodedata.category(chr(code)) == "Zs" or 9 <= code <= 13 or code in (0x85, 0x2028, 0x2029):
            plain[chr(code)] = " "
    plain.pop(" ", None)
    plain |= dict.fromkeys(_DASHES, "-")
    gone = "".join(map(chr, _INKLESS))
    shapes = {x: shape for shape, others in LOOK_ALIKES.items() for x in others}
    return {x: y for x, y in plain.items() if x not in gone}, shapes, gone


_PLAIN, _SHAPES, _GONE = _character_maps()
#: Base and mark, of bases that have a look-alike, with the sign that both make: joined before the base is mapped.
_MARKED = {unicodedata.normalize("NFD", c): c for c in map(chr, range(0x3041, 0x3100)) if len(unicodedata.normalize("NFD", c)) == 2 and unicodedata.normalize("NFD", c)[0] in _SHAPES}


def readable_form(text: Column) -> Column:
    """`text` with one width, one blank, one dash, signs instead of radicals, nothing inkless, and no blanks or dashes at its ends.

    NULL gives NULL; a text without ink gives ''. One table lookup per character, in the JVM.
    """
    return F.regexp_replace(F.translate(text, "".join(_PLAIN) + _GONE, "".join(_PLAIN.values())), r"^[ \-]+|[ \-]+$", "")


def look_alike_form(readable: Column) -> Column:
    """A readable form with each letter replaced by the one that stands for its shape.

    Combining marks stay: canonically equal sequences are made equal by the collation under which forms are compared.
    """
    joined = readable
    for pair, sign in _MARKED.items():
        joined = F.replace(joined, F.lit(pair), F.lit(sign))
    return F.translate(joined, "".join(_SHAPES), "".join(_SHAPES.values()))


def form_sql(column: str) -> tuple[str, str]:
    """SQL of the readable form of a column, and of the class key of a column of such forms, for engines with translate and nfc_normalize."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    readable = f"regexp_replace(translate({column}, {quoted(''.join(_PLAIN) + _GONE)}, {quoted(''.join(_PLAIN.values()))}), '^[ \\-]+|[ \\-]+$', '', 'g')"
    joined = "plain"
    for pair, sign in _MARKED.items():
        joined = f"replace({joined}, {quoted(pair)}, {quoted(sign)})"
    return readable, f"nfc_normalize(translate({joined}, {quoted(''.join(_SHAPES))}, {quoted(''.join(_SHAPES.values()))}))"


def visual_classes(values: DataFrame, scope: list[str], text: str) -> DataFrame:
    """`values` with `form`, its class's canonical member.

    A class holds the values of one `scope` whose look-alike forms are equal under the accent- and
    case-sensitive Unicode collation. Its canonical member is the readable form of the commonest
    spelling, then the shortest, then the smallest, so it doesn't depend on the order of rows. Each
    different value is mapped, grouped and joined back once, so repeats of a hot value cost nothing.
    Rows with NULL text keep a NULL form and are in no class.
    """
    each = values.where(F.col(text).isNotNull()).groupBy(*scope, text).agg(F.count("*").alias("_n"))
    mapped = each.select(*[F.col(c).alias(f"_s_{c}") for c in scope], F.col(text).alias("_text"), "_n", readable_form(F.col(text)).alias("_plain"))
    keyed = mapped.withColumn("_class", F.collate(look_alike_form(F.col("_plain")), "UNICODE"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.length("_plain").alias("l"), F.col("_plain").alias("form")))["form"]
    canon = keyed.groupBy(*[f"_s_{c}" for c in scope], "_class").agg(best.alias("form"), F.count("*").alias("spellings"))
    named = keyed.alias("k").join(canon.alias("c"), [F.col(f"k._s_{c}").eqNullSafe(F.col(f"c._s_{c}")) for c in scope] + [F.col("k._class") == F.col("c._class")])
    found = named.select(*[F.col(f"k._s_{c}") for c in scope], "_text", "form", "spellings")
    back = [values[c].eqNullSafe(found[f"_s_{c}"]) for c in scope] + [values[text] == found["_text"]]
    return values.join(found, back, "left").select(*[values[c] for c in values.columns], "form", "spellings")


def visual_pairs(values: DataFrame, scope: list[str], row: str, text: str) -> DataFrame:
    """(`scope`, `id_a`, `id_b`): rows with different ids whose texts differ but look the same, the smaller id first.

    Only classes with several spellings enter the pairing; rows of the same spelling aren't paired.
    """
    rows = visual_classes(values.select(*scope, row, text).distinct(), scope, text).where("spellings > 1").drop("spellings")
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in scope] + [F.col("a.form") == F.col("b.form"), F.col(f"a.{text}") != F.col(f"b.{text}"), F.col(f"a.{row}") < F.col(f"b.{row}")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return a.join(b, condition).select(*[F.col(f"a.{c}").alias(c) for c in scope], F.col(f"a.{row}").alias("id_a"), F.col(f"b.{row}").alias("id_b")).distinct()
