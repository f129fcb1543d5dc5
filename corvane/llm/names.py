"""Names as people type them: parts, readings, and the canonical rewritings under which variants meet."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Syllables by row and vowel; a blank stands for a gap.
_KANA_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "y": "や ゆ よ", "r": "らりるれろ", "w": "わゐ ゑを", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_IRREGULAR = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ん": "n", "ゐ": "i", "ゑ": "e", "ゔ": "vu"}
_SMALL = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゎ": "wa"}
# Old forms of characters used in names, each before its new form.
OLD_FORMS = "榮栄 瀨瀬 彌弥 濱浜 穗穂 澤沢 惠恵 樂楽 實実 國国 廣広 齋斎 齊斉 邊辺 邉辺 眞真 龍竜 櫻桜 壽寿 德徳 淸清 靜静 瀧滝 嶋島 嶌島 髙高 﨑崎 將将 豐豊 藏蔵 圓円 鐵鉄 應応 學学 禮礼 曉暁 來来 峯峰 晝昼 螢蛍 槇槙 繪絵 絲糸 鷗鴎 鶯鴬 賴頼 祿禄 萬万 戀恋 歸帰 與与 傳伝 潛潜 燈灯 獨独 舊旧 藝芸 單単 號号 縣県 關関 黑黒 橫横 譽誉 巖巌 遙遥 薰薫 莊荘 檜桧 蠶蚕 覺覚 聰聡 總総 增増 凉涼 步歩 每毎 愼慎 歷歴 綠緑 亞亜 麥麦 鷄鶏 澁渋 條条 攝摂 畫画 氣気 戶戸 峽峡 鄕郷 渕淵 廐厩".split()
_OLD = {ord(x[0]): x[1] for x in OLD_FORMS}
# What is added to a name but isn't part of it, and endings of pet names.
HONORIFICS = ["さん", "様", "さま", "氏", "くん", "君", "先生", "女士", "小姐", "老师", "san", "sama", "kun"]
PET_ENDINGS = ["ちゃん", "たん", "ちん", "チャン", "タン", "-chan", " chan", "chan", "-tan"]
TITLES = ["dr", "dr.", "mr", "mr.", "ms", "ms.", "mrs", "mrs.", "miss", "prof", "prof."]
#: Legal forms and words for a group, dropped from names of organisations and ensembles.
LEGAL_FORMS = ["株式会社", "有限会社", "合同会社", "有限公司", "股份有限公司", "(株)", "(有)", "inc", "inc.", "ltd", "ltd.", "co.", "llc", "gmbh", "k.k."]
_LEGAL, _HONORIFICS = tuple(LEGAL_FORMS), tuple(HONORIFICS)
_HAN = re.compile(r"[一-鿿㐀-䶿豈-﫿々〆ヶ]+")
_KANA = re.compile(r"[ぁ-ゖァ-ヺー゙゚]+")
#: Text that cleaning leaves as it is, but for blanks.
_PLAIN = re.compile(r"[ !-~]*|[ 一-鿿々ぁ-ゖァ-ヺー]*")
_BRACKETS = re.compile(r"[(（\[【](.*?)[)）\]】]")


def _syllables() -> dict[str, str]:
    table = {c: r + "aiueo"[i] for r, row in _KANA_ROWS.items() for i, c in enumerate(row) if c != " "}
    return table | _IRREGULAR


_SYLLABLES = _syllables()


def clean(name: str) -> str:
    """One width, no characters without ink, one blank between words, new forms of characters."""
    if _PLAIN.fullmatch(name):
        return " ".join(name.split()).translate(_OLD)
    text = unicodedata.normalize("NFKC", name)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") and not ("︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"))
    text = re.sub(r"[‐-―−﹣]", "-", unicodedata.normalize("NFC", text))
    return re.sub(r"\s+", " ", text).strip().translate(_OLD)


@lru_cache(maxsize=200_000)
def kana_to_latin(text: str) -> str:
    """Hepburn letters of kana; other characters stay."""
    if text.isascii():
        return text
    out = ""
    double = False
    for c in text:
        c = chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
        if c in "ゃゅょ" and out.endswith("i"):
            out = out[:-1] + (_SMALL[c][1:] if out.endswith(("shi", "chi", "ji")) else _SMALL[c])
        elif c == "っ":
            double = True
        elif c == "ー":
            out += out[-1:]
        else:
            s = _SYLLABLES.get(c) or _SMALL.get(c) or c
            out += s[0] + s if double else s
            double = False
    return out


# Each rule with the letters without which it changes nothing.
_LATIN_RULES = [(needs, re.compile(p), r) for needs, p, r in [("y", "sy", "sh"), ("y", "ty", "ch"), ("y", "[zj]y", "j"), ("si", "si", "shi"), ("ti", "ti", "chi"), ("tu", "tu", "tsu"), ("hu", "(?<![sc])hu", "fu"), ("zi", "zi", "ji"), ("di", "di", "ji"), ("d", "d[zu]u?", "zu"), ("m", "m(?=[bp])", "n"), ("wo", "wo", "o"), ("l", "l", "r")]]
_LONG, _DOUBLE = re.compile(r"o[uh](?![aeiou])|ou"), re.compile(r"(.)\1+")


@lru_cache(maxsize=200_000)
def reading(text: str) -> str:
    """One spelling for all romanisations of a reading: other systems become Hepburn, long vowels and double letters single, marks and signs are dropped."""
    latin = letters(text).replace("du", "zu")
    for needs, rule, by in _LATIN_RULES:
        if needs in latin:
            latin = rule.sub(by, latin)
    return _DOUBLE.sub(r"\1", _LONG.sub("o", latin))


@dataclass(frozen=True)
class Parts:
    """A typed name: kind (full, initial, pet, whole), two parts, and whether the first is the family name (F), the given name (G) or unknown (?).

    A pet form without family name has an empty first part.
    """

    kind: str
    first: str
    second: str = ""
    order: str = "F"


@lru_cache(maxsize=200_000)
def is_han(text: str) -> bool:
    return bool(text) and _HAN.fullmatch(text) is not None


def _two(text: str) -> tuple[str, str] | None:
    """Family and given name of an unspaced East Asian name: 2 + 2 characters, or where the script changes. Other splits ask for a dictionary."""
    if is_han(text):
        return (text[:2], text[2:]) if len(text) == 4 else None
    m = re.fullmatch(f"({_HAN.pattern})({_KANA.pattern})", text) or re.fullmatch(f"({_KANA.pattern})({_HAN.pattern})", text)
    return (m[1], m[2]) if m else None


@lru_cache(maxsize=200_000)
def parse(name: str) -> Parts | None:
    """The parts of a typed name, None if it has none."""
    text = clean(name)
    inside = [x.strip() for x in _BRACKETS.findall(text)]
    text = _BRACKETS.sub(" ", text).strip()
    text = re.sub(r"\s+", " ", re.sub(r"[・·･]", " ", text))
    low = text.lower()
    for form in LEGAL_FORMS if low.startswith(_LEGAL) or low.endswith(_LEGAL) else ():
        if low.startswith(form) or low.endswith(" " + form) or (low.endswith(form) and not form.isascii()):
            text = text[len(form) :].strip() if low.startswith(form) and not form.isascii() else text[: -len(form)].strip() if low.endswith(form) else text
            low = text.lower()
    for h in HONORIFICS if low.endswith(_HONORIFICS) else ():
        if len(text) > len(h) + 1 and (low.endswith(h) if not h.isascii() else low.endswith(("-" + h, " " + h))):
            text = text[: -len(h)].strip(" -")
            low = text.lower()
            break
    if not text:
        return None
    pet = _pet(text, inside)
    if pet:
        return pet
    if "," in text:
        a, _, b = text.partition(",")
        a, b = a.strip(), b.strip()
        return _with_initial(a, b, "F") if a and b else Parts("whole", a or b)
    words = text.split(" ")
    if len(words) > 2 and words[0].lower() in TITLES:
        words = words[1:]
    if len(words) == 3 and text.isascii() and re.fullmatch(r"[A-Za-z]\.?", words[1]):
        words = [words[0], words[2]]
    if len(words) == 1 and re.fullmatch(r"[A-Z][A-Z][a-z]{2,}", text):
        return Parts("initial", text[1:], text[0].lower(), "F")
    if len(words) == 1 and text.isascii():
        words = [w for w in re.split(r"(?<=\.)(?=\w)|-", text) if w]
    if len(words) == 2:
        latin = words[0].isascii() and words[1].isascii()
        return _with_initial(words[0], words[1], "G" if latin else "?" if is_han(words[0]) and is_han(words[1]) else "F")
    if len(words) == 1:
        two = _two(text.replace("-", ""))
        if "-" in text and not text.isascii():
            a, _, b = text.partition("-")
            two = (a, b) if a and b else two
        return Parts("full", two[0], two[1], "F") if two else Parts("whole", text)
    return Parts("whole", "".join(words) if not text.isascii() else text)


def _with_initial(a: str, b: str, order: str) -> Parts:
    letter = lambda x: re.fullmatch(r"[A-Za-z]\.?", x) is not None
    if letter(b) and not letter(a):
        return Parts("initial", a, b[0].lower(), "?")
    if letter(a) and not letter(b):
        return Parts("initial", b, a[0].lower(), "F")
    return Parts("full", a, b, order)


def _pet(text: str, inside: list[str]) -> Parts | None:
    """Family name and the beginning of a given name: 'Shi-chan Koe', a name ending in a pet form, or a pet form with the family in brackets."""
    latin = any(x in text.lower() for x in ("chan", "tan"))
    m = latin and (re.fullmatch(r"(\w+?)-?(?:chan|tan)[ ,]+(\w+)", text, re.I) or re.fullmatch(r"(?P<f>\w+)[ ,]+(?P<g>\w+?)-?(?:chan|tan)", text, re.I))
    if m and text.isascii():
        groups = m.groupdict()
        return Parts("pet", groups.get("f") or m[2], groups.get("g") or m[1], "F")
    for ending in PET_ENDINGS:
        if not ending.isascii() and text.endswith(ending) and len(text) > len(ending) + 1:
            stem = text[: -len(ending)].strip()
            if inside and inside[0]:
                return Parts("pet", inside[0], stem, "F")
            words = stem.split(" ")
            two = (words[0], words[1]) if len(words) == 2 else _two(stem) or ((stem[:2], stem[2:]) if is_han(stem[:2]) and len(stem) > 2 else None)
            return Parts("pet", two[0], two[1], "F") if two else Parts("pet", "", stem, "F")
    m = latin and re.fullmatch(r"([A-Za-z]{2,}?)-(?:chan|tan)", text, re.I)
    return Parts("pet", "", m[1], "F") if m else None


def letters(text: str) -> str:
    """The letters of a Latin or kana word as typed, in lower case."""
    if text.isascii() and text.isalpha():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", kana_to_latin(text).lower()) if "a" <= c <= "z")


def deletions(word: str) -> set[str]:
    """The word and what remains after leaving out one letter: two words one slip apart have one of these in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def remains(word: str) -> dict[str, int]:
    """What is left of a word after leaving out none, one or, of six letters or more, two letters, with the number left out."""
    out = {word: 0}
    if len(word) >= 3:
        for x in deletions(word):
            out.setdefault(x, 1)
    if len(word) >= 6:
        for x in [x for x, n in out.items() if n == 1]:
            for y in deletions(x):
                out.setdefault(y, 2)
    return out
