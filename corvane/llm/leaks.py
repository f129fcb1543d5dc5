"""Passages of held-out test items in a corpus, found by spaced seeds and verified by local alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.filters import BITS, filter_of, passes
from corvane.session import cut_lineage

#: Fixed masks: 1 a token that must agree, 0 one that may differ. Words and single East Asian characters have their own.
WORD_MASKS = ["111111", "1110111", "110110011", "1010111001"]
SIGN_MASKS = ["1111111111", "11110110111011", "110111011011011"]
#: A passage has at least so many words or signs; of its tokens and of their weights at least these shares agree.
LEAST_WORDS, LEAST_SIGNS, AGREEMENT, WEIGHT_AGREEMENT = 12, 24, 0.85, 0.75
#: How far an alignment may drift from a seed's diagonal by left out and added tokens.
BAND = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIGN = "぀-ヿ㐀-䶿一-鿿豈-﫿々〆ｦ-ﾟ"
_TOKEN = re.compile(rf"[{_SIGN}]|[^\W_{_SIGN}]+")
_INKLESS = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]")
_APOSTROPHE = re.compile(r"(?<=\w)['’](?=\w)")
_MARKUP = re.compile(r"<[/!?|]?[A-Za-z\-|][^<>]*>|&[a-z]{2,8};|&#\d{1,6};")


def tokens(text: str) -> list[str]:
    """Words and single East Asian characters without case, width, marks, mark-up, punctuation and characters without ink."""
    plain = _INKLESS.sub("", unicodedata.normalize("NFKC", _MARKUP.sub(" ", text)).lower())
    return _TOKEN.findall(_APOSTROPHE.sub("", plain))


def _is_sign(token: str) -> bool:
    return len(token) == 1 and re.match(f"[{_SIGN}]", token) is not None


def token_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens, and which are East Asian signs."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64), np.array([_is_sign(w) for w in words], bool)


def seeds(codes: np.ndarray, sign: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all spaced seeds: word masks where the window begins with a word, sign masks where with a sign.

    text: the number of the text to which each token belongs; a window lies within one.
    """
    found, places = [], []
    for number, (mask, signs) in enumerate([(m, False) for m in WORD_MASKS] + [(m, True) for m in SIGN_MASKS]):
        span = len(mask)
        n = len(codes) - span + 1
        if n <= 0:
            continue
        at = np.flatnonzero((sign[:n] == signs) & (text[:n] == text[span - 1 :]))
        h = np.full(len(at), number + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ codes[at + k]) * _MIX
                h ^= h >> np.uint64(29)
        found.append(h)
        places.append(at)
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def weight_keys(codes: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """What is counted for the rarity of each token: the word itself, or a sign joined with the following token."""
    after = np.append(codes[1:], np.uint64(1)) if len(codes) else codes
    return np.where(sign, (codes * _MIX) ^ after, codes).view(np.int64)


def align(windows: np.ndarray, items: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each pair, all at once: span in the item, agreeing tokens, per mille of agreeing weight, begin and end in the window.

    windows: document tokens around the pair's diagonal, BAND more on either side than the item is long. An agreeing
    token gains its weight, a changed or left out one costs as much, an added one costs the mean weight. Frequent
    words of a common pattern thus neither make nor carry a passage.
    """
    pairs, length = items.shape
    width = 2 * BAND + 1
    mean = (weights.sum(1) / np.maximum(lengths, 1)).astype(np.float32)
    # of each cell: score, weight passed, span, agreeing tokens, begin; the last row stands for what lies outside the band
    score, passed = np.zeros((width + 1, pairs), np.float32), np.zeros((width + 1, pairs), np.float32)
    span, same, begin = (np.zeros((width + 1, pairs), np.int32) for _ in range(3))
    best, best_passed = np.zeros(pairs, np.float32), np.ones(pairs, np.float32)
    out = np.zeros((5, pairs), np.int32)
    for i in range(length):
        w, x, live = weights[:, i], items[:, i], i < lengths
        for b in range(width):
            hit = (windows[:, i + b] == x) & live
            fresh = score[b] <= 0
            cell = [score[b] + np.where(hit, w, -w), passed[b] + w, span[b] + 1, same[b] + hit, np.where(fresh, i + b, begin[b])]
            gap = score[b + 1] - w  # left out in the document
            take = gap > cell[0]
            cell = [np.where(take, y, z) for y, z in zip((gap, passed[b + 1] + w, span[b + 1] + 1, same[b + 1], begin[b + 1]), cell, strict=True)]
            if b:  # added in the document
                gap = score[b - 1] - mean
                take = gap > cell[0]
                cell = [np.where(take, y, z) for y, z in zip((gap, passed[b - 1] + mean, span[b - 1], same[b - 1], begin[b - 1]), cell, strict=True)]
            alive = (cell[0] > 0) & live
            for field, value in zip((score, passed, span, same, begin), cell, strict=True):
                field[b] = np.where(alive, value, 0)
            more = score[b] > best
            if more.any():
                best, best_passed = np.where(more, score[b], best), np.where(more, passed[b], best_passed)
                out[0], out[1], out[3] = np.where(more, span[b], out[0]), np.where(more, same[b], out[1]), np.where(more, begin[b], out[3])
                out[4] = np.where(more, i + b + 1, out[4])
    out[2] = (500 * (best + best_passed) / np.maximum(best_passed, 1e-6)).astype(np.int32)
    return out


def hopeful(windows: np.ndarray, items: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs may hold a passage: those with a stretch of `least` or more item tokens of which AGREEMENT occur in the window at all.

    What an alignment finds agrees in order too, so none is lost. windows, items: as in align().
    """
    pairs, length = items.shape
    gain = np.zeros((pairs, length + 1))
    for i in range(length):
        gain[:, i + 1] = (windows == items[:, i : i + 1]).any(1) - AGREEMENT
    total = np.cumsum(gain, 1)
    best = np.full(pairs, -np.inf)
    for least_length in np.unique(least).tolist():
        mine = (least == least_length) & (lengths >= least_length)
        if mine.any() and length >= least_length:
            t = total[mine]
            ends = np.where(np.arange(length + 1)[None, :] <= lengths[mine][:, None], t, -np.inf)[:, least_length:]
            best[mine] = (ends - np.minimum.accumulate(t, 1)[:, : length + 1 - least_length]).max(1)
    return best >= -1e-9


def verify(cases: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]], at_once: int = 2_048) -> np.ndarray:
    """Best passages (see align, places in the document) of (document codes, item codes, item weights, diagonal, whether in signs); zeros where none is possible."""
    order = np.argsort([len(c[1]) for c in cases], kind="stable")
    out = np.zeros((5, len(cases)), np.int32)
    waiting: list[tuple] = []

    def finish() -> None:
        if waiting:
            part, windows, items, weights, firsts, lengths = (np.concatenate(x) if x[0].ndim == 1 else _stacked(x) for x in zip(*waiting, strict=True))
            found = align(windows, items, weights, lengths)
            found[3:] += firsts
            out[:, part] = found
            waiting.clear()

    for start in range(0, len(order), at_once):
        part = order[start : start + at_once]
        lengths = np.array([len(cases[k][1]) for k in part])
        most = int(lengths.max(initial=0))
        windows, items, weights = np.zeros((len(part), most + 2 * BAND + 1), np.int64), np.full((len(part), most), -1, np.int64), np.zeros((len(part), most), np.float32)
        firsts = np.array([cases[k][3] - BAND for k in part])
        least = np.array([LEAST_SIGNS if cases[k][4] else LEAST_WORDS for k in part])
        for r, k in enumerate(part):
            doc, item, weight = cases[k][:3]
            first = int(firsts[r])
            lo, hi = max(first, 0), min(len(doc), first + windows.shape[1])
            if hi > lo:
                windows[r, lo - first : hi - first] = doc[lo:hi]
            items[r, : len(item)], weights[r, : len(item)] = item, weight
        may = hopeful(windows, items, lengths, least)
        if may.any():
            waiting.append((part[may], windows[may], items[may], weights[may], firsts[may], lengths[may]))
        if sum(len(w[0]) for w in waiting) >= at_once:
            finish()
    finish()
    return out


def _stacked(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows of several widths one under the other, filled up with zeros, which lie behind the end of an item."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


# --- the distributed search ---------------------------------------------------------------------------


def _tokenised(b: pd.DataFrame, key: str, text: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and of all tokens of a batch: codes, which are signs, the text's number; last where each text begins."""
    words = [tokens(t) if t else [] for t in b[text]]
    known: dict[str, tuple[int, bool]] = {}
    import xxhash

    flat = [known.get(w) or known.setdefault(w, (xxhash.xxh64_intdigest(w.encode()), _is_sign(w))) for x in words for w in x]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes, sign = np.array([c for c, _ in flat], np.uint64), np.array([s for _, s in flat], bool)
    return list(b[key]), codes, sign, np.repeat(np.arange(len(words)), sizes), np.r_[0, np.cumsum(sizes)]


def _short(codes: np.ndarray) -> np.ndarray:
    """Codes as they are stored for comparing: 31 bits, never the fillers of verify."""
    return ((codes >> np.uint64(33)).astype(np.int64) + 1).astype(np.int32) & 0x7FFFFFFF


def item_tables(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(`item`, `codes`, `weights`, `signs` whether most tokens are signs) and (`hash`, `item`, `place`) of the test items.

    A token's weight is the rarity of the word, or of a sign with the next one, among all items.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, codes, sign, text_no, begin = _tokenised(b, key, text)
            kinds = weight_keys(codes, sign)
            yield pd.DataFrame({"item": [keys[k] for k in text_no], "place": np.arange(len(codes)) - begin[text_no], "code": _short(codes), "kind": kinds, "sign": sign.astype(int)})

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, codes, sign, text_no, begin = _tokenised(b, key, text)
            h, at = seeds(codes, sign, text_no)
            yield pd.DataFrame({"hash": h.view(np.int64), "item": [keys[k] for k in text_no[at]], "place": at - begin[text_no[at]]})

    base = items.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    long = cut_lineage(base.mapInPandas(read, "item long, place int, code int, kind long, sign int"))
    n = max(long.select("item").distinct().count(), 1)
    rare = long.select("item", "kind").distinct().groupBy("kind").agg(F.count("*").alias("df"))
    weighted = long.join(rare, "kind").withColumn("weight", F.greatest(F.log(F.lit(n + 1) / F.col("df")), F.lit(0.05)).cast("float"))
    rows = weighted.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "code", "weight"))).alias("t"), F.avg("sign").alias("signs"))
    table = rows.select("item", F.col("t.code").alias("codes"), F.col("t.weight").alias("weights"), (F.col("signs") > 0.5).alias("signs"))
    return cut_lineage(table), cut_lineage(base.mapInPandas(seed, "hash long, item long, place int"))


def leaked_passages(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(`doc`, `item`, `span`, `same`, `begin`, `end`): documents that hold a passage of an item, with the best one of each pair.

    A passage has LEAST_WORDS words (LEAST_SIGNS signs for items in Chinese or Japanese) of the item in its order;
    of these tokens AGREEMENT, and of their weight WEIGHT_AGREEMENT, agree. Of two items whose passages overlap
    in a document, as items made after one pattern do, the one that agrees clearly less is left out.

    Every document is read once, whole. Its spaced seeds pass a filter of fixed size, the rest is an equi-join on the seed's
    hash; only documents with a hit keep their tokens, and only pairs with a hit are aligned. NULL and empty texts hold nothing;
    a document or item id that is NULL is left out. Repeats of a document are searched each for itself.
    """
    table, item_seeds = item_tables(items, item_key, item_text)
    members = filter_of(item_seeds.select(F.pmod("hash", F.lit(BITS))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, codes, sign, text_no, begin = _tokenised(b, key, text)
            h, at = seeds(codes, sign, text_no)
            hit = passes(members.value, h)
            h, at = h[hit].view(np.int64), at[hit]
            by = np.argsort(text_no[at], kind="stable")
            h, at = h[by], at[by]
            hit = text_no[at]
            starts = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]]) if len(hit) else np.zeros(0, int)
            short = _short(codes)
            rows = [(keys[n], short[begin[n] : begin[n + 1]], h[s:e], (at[s:e] - begin[n]).astype(np.int32)) for n, s, e in zip(hit[starts], starts, np.r_[starts[1:], len(hit)][: len(starts)], strict=True)]
            yield pd.DataFrame(rows, columns=["doc", "codes", "hashes", "places"])

    read = documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    held = cut_lineage(read.mapInPandas(scan, "doc long, codes array<int>, hashes array<long>, places array<int>"))
    hits = held.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("z")).select("doc", F.col("z.hashes").alias("hash"), F.col("z.places").alias("at"))
    met = hits.join(item_seeds, "hash").select("doc", "item", (F.floor((F.col("at") - F.col("place")) / (BAND // 2)) * (BAND // 2) + BAND // 4).cast("int").alias("diagonal")).distinct()
    cases = met.join(held.select("doc", "codes"), "doc").join(table.select("item", F.col("codes").alias("item_codes"), "weights", "signs"), "item")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = verify(list(zip(b["codes"], b["item_codes"], b["weights"], b["diagonal"], b["signs"], strict=True)))
            yield pd.DataFrame({"doc": b["doc"], "item": b["item"], "signs": b["signs"], "span": found[0], "same": found[1], "weighed": found[2], "begin": found[3], "end": found[4]})

    aligned = cut_lineage(cases.mapInPandas(check, "doc long, item long, signs boolean, span int, same int, weighed int, begin int, end int"))
    long_enough = F.col("span") >= F.when(F.col("signs"), LEAST_SIGNS).otherwise(LEAST_WORDS)
    good = aligned.where(long_enough & (F.col("same") >= AGREEMENT * F.col("span")) & (F.col("weighed") >= 1000 * WEIGHT_AGREEMENT))
    best = good.groupBy("doc", "item").agg(F.max(F.struct("same", "weighed", "span", "begin", "end")).alias("p")).select("doc", "item", "p.*")
    best = cut_lineage(best)
    a, o = best.alias("a"), best.alias("o")
    overlap = F.least("a.end", "o.end") - F.greatest("a.begin", "o.begin")
    better = (F.col("a.doc") == F.col("o.doc")) & (F.col("a.item") != F.col("o.item")) & (overlap * 2 > F.col("a.end") - F.col("a.begin")) & (F.col("o.weighed") >= F.col("a.weighed") + 60) & (F.col("o.same") >= F.col("a.same"))
    return a.join(o, better, "left_anti").select("doc", "item", "span", "same", "begin", "end")
