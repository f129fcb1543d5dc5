"""Scoring documents for abusive, hateful or sexual passages by maximum-scoring segments."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.visual_forms import LOOK_ALIKES
from corvane.session import cut_lineage

#: Labelled documents that the model is fitted on at most; of more, those with the smallest hash of their id.
LABELLED_DOCUMENTS = 8_000
#: Strength of the Dirichlet prior: pseudo-documents that follow the corpus.
PRIOR = 5.0
#: Bounds of a token's log-odds, the least deviation of its count in standard deviations, and what every position costs.
CLIP, RELIABLE, DRIFT = 3.0, 1.0, 0.45
#: Rounds in which passages found in abusive documents replace whole documents as the abusive text.
ROUNDS = 3
#: Least score of such a passage.
PASSAGE = 6.0
#: Positions of a document to which the calibration refers.
TYPICAL_LENGTH = 200.0
#: Documents of either kind of label in which a feature must occur to be counted.
LEAST_ABUSIVE, LEAST_PLAIN = 2, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)

_SIGN = "぀-ヿ㐀-䶿一-鿿豈-﫿々〆"
_INKLESS = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]")
_BETWEEN_SIGNS = re.compile(rf"(?<=[{_SIGN}])[\s.*·•_/\\~+=|^#@\-．・／＊]{{1,3}}(?=[{_SIGN}])")
_SPACED_LETTERS = re.compile(r"(?<![^\W_])(?:[^\W\d_]|[\d@$])(?:[.*·•_/\- ](?:[^\W_]|[@$])){2,}(?![^\W_])")
_BETWEEN_LETTERS = re.compile(r"[.*·•_/\- ]")
_TOKEN = re.compile(rf"[{_SIGN}]|(?:[^\W_{_SIGN}]|[@$'*])+|[.!?。！？\n]")
_STOP = set(".!?。！？\n")
# Digits and signs written for letters.
_WRITTEN_FOR = str.maketrans("013457@$8", "oieastasb")
_LATIN_SHAPES = {x: shape for shape, others in LOOK_ALIKES.items() if shape.isascii() for x in others}
_SHAPED = re.compile("[" + "".join(_LATIN_SHAPES) + "]")


def words(text: str) -> list[str]:
    """Words and East Asian signs with disguises taken off, and full stops.

    Width, case, marks and characters without ink don't matter; blanks, dots and other signs put between the letters of a
    word or between East Asian signs are dropped; digits within a word of letters are read as the letters they stand for.
    """
    plain = _INKLESS.sub("", unicodedata.normalize("NFKC", text))
    plain = _SHAPED.sub(lambda m: _LATIN_SHAPES[m[0]], plain).lower()
    plain = _BETWEEN_SIGNS.sub("", plain)
    plain = _SPACED_LETTERS.sub(lambda m: _BETWEEN_LETTERS.sub("", m[0]), plain)
    out = []
    for w in _TOKEN.findall(plain):
        if len(w) > 1 and not w.isalpha():
            w = w.strip("'*")
            if any(c in "013457@$8" for c in w) and sum(c.isalpha() for c in w) * 2 >= len(w) and not w[-2:].isdigit():
                w = w.translate(_WRITTEN_FOR)
            w = w.replace("'", "").replace("*", "")
        if w:
            out.append(w)
    return out


def word_codes(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the 32-bit codes of its words in order, 0 where a sentence ends."""
    import xxhash

    known: dict[str, int] = dict.fromkeys(_STOP, 0)
    out = []
    for t in texts:
        flat = []
        for w in words(t) if t else []:
            c = known.get(w)
            if c is None:
                c = known[w] = xxhash.xxh32_intdigest(("#" * len(w) if w.isdigit() else w).encode()) | 1
            flat.append(c)
        out.append(np.array(flat, np.uint32).view(np.int32))
    return out


def joined_features(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text, stop): per position three 64-bit codes (the word, with the next, with the next two), the text's number, and whether a sentence ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    one = (np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)).astype(np.int32).view(np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    stop = one == 0
    n = len(one)
    codes = np.zeros((3, n), np.uint64)
    codes[0] = one
    for k in (1, 2):
        if n > k:
            joined = (codes[k - 1][: n - k] * _MIX) ^ one[k:]
            joined ^= joined >> np.uint64(31)
            fits = (text[: n - k] == text[k:]) & ~stop[k:] & (codes[k - 1][: n - k] != 0)
            codes[k][: n - k] = np.where(fits, joined | np.uint64(1 << 33), 0)
    return codes, text, stop


def distinct_pairs(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The different values of text * width + at, sorted; of 32 bits where these suffice, which sort several times faster."""
    kind = np.uint32 if (int(text.max(initial=0)) + 1) * width < 1 << 32 else np.uint64
    keys = text.astype(kind) * kind(width) + at.astype(kind)
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


@dataclass
class Model:
    """Sorted feature codes with their scores; location and scale of the Gumbel law that best scores of plain documents follow; the level from which a document counts as abusive."""

    codes: np.ndarray
    scores: np.ndarray
    location: float = 0.0
    scale: float = 1.0
    level: float = 0.0

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """The score of each position: the log-odds of its features, less the drift."""
        total = np.full(codes.shape[1], -DRIFT, np.float32)
        for c in codes if len(self.codes) else ():
            at = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
            total += np.where((self.codes[at] == c) & (c != 0), self.scores[at], 0).astype(np.float32)
        return np.where(codes[0] == 0, -DRIFT, total)

    def p_values(self, best: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The chance that a plain document of this length has a passage that scores as much."""
        x = (best - self.location) / self.scale - np.log(np.maximum(lengths, 1) / TYPICAL_LENGTH)
        return np.where(best > 0, -np.expm1(-np.exp(-np.clip(x, -50, 700))), 1.0)


def best_segments(scores: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, begin, end) of the maximum-scoring segment of each text, in one pass over all positions.

    A running sum minus its least value since the text began; 0 where nothing scores above 0.
    """
    best, begin, end = np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if not len(scores):
        return best, begin, end
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    total = np.cumsum(scores, dtype=np.float64)
    before = total - scores  # the sum before each position
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(text)].tolist(), strict=True):
        low = np.minimum.accumulate(before[s:e])
        gain = total[s:e] - low
        k = int(gain.argmax())
        if gain[k] > 0:
            best[text[s]], end[text[s]] = gain[k], s + k + 1
            begin[text[s]] = s + int(np.flatnonzero(before[s : s + k + 1] == low[k])[-1])
    return best, begin, end


def all_segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All disjoint maximal segments of one text that score at least `least`, in linear time."""
    stack: list[list[float]] = []  # begin, end, sum before, sum at its end
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        seg = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j -= 1
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(int(b), int(e), t - f) for b, e, f, t in stack if t - f >= least]


def log_odds(abusive: np.ndarray, plain: np.ndarray, corpus: np.ndarray, n_abusive: float, n_plain: float, n_corpus: float) -> np.ndarray:
    """Log-odds of each feature in abusive documents under a Dirichlet prior that follows the corpus: the smaller of those against plain documents and against the whole corpus.

    Counts are of documents. The corpus corrects what the small, biased sample of plain documents lacks. A feature whose
    count doesn't differ from the expected one by RELIABLE standard deviations scores 0.
    """
    rate = (corpus + 0.5) / (n_corpus + 1)
    prior = PRIOR * rate
    a, p = abusive + prior, plain + prior
    odds = np.log(a / np.maximum(n_abusive + PRIOR - a, 0.5))
    usual = np.maximum(p / (n_plain + PRIOR), rate)
    delta = odds - np.log(usual / np.maximum(1 - usual, 1e-3))
    expected = n_abusive * usual
    sure = np.where(delta > 0, abusive - expected >= RELIABLE * np.sqrt(np.maximum(abusive, 1)), expected - abusive >= RELIABLE * np.sqrt(np.maximum(expected, 1)))
    return np.where(sure, np.clip(delta, -CLIP, CLIP), 0).astype(np.float32)


# --- fitting ---------------------------------------------------------------------------------------------


class Labelled:
    """The labelled sample: its features as indices into a vocabulary. texts: the word codes of each document."""

    def __init__(self, texts: list[np.ndarray], abusive: np.ndarray) -> None:
        codes, self.text, self.stop = joined_features(texts)
        self.abusive = abusive
        self.documents = len(texts)
        self.lengths = np.bincount(self.text, minlength=self.documents)
        every, at = np.unique(codes.reshape(-1), return_inverse=True)
        at = at.reshape(codes.shape)
        pairs = self._pairs(at, self.text, len(every))
        of_abusive = abusive[pairs // len(every)]
        yes = np.bincount(pairs[of_abusive] % len(every), minlength=len(every))
        no = np.bincount(pairs[~of_abusive] % len(every), minlength=len(every))
        keep = ((yes >= LEAST_ABUSIVE) | (no >= LEAST_PLAIN)) & (every != 0)
        self.vocabulary = every[keep]
        place = np.where(keep, np.cumsum(keep) - 1, len(self.vocabulary))  # the last index stands for what isn't counted
        self.codes = codes
        self.begin = np.r_[0, np.cumsum(self.lengths)]
        self.width = len(self.vocabulary) + 1
        at = place[at]
        # features of whole documents, once each; of abusive ones also all positions, as passages are cut out of them
        pairs = self._pairs(at, self.text, self.width)
        self._owner, self._feature = pairs // self.width, pairs % self.width
        mine = abusive[self.text]
        self._positions = np.flatnonzero(mine)
        self._at = at[:, mine]

    @staticmethod
    def _pairs(at: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
        return distinct_pairs(np.tile(text, len(at)), at.reshape(-1), width).astype(np.int64)

    def _whole(self, documents: np.ndarray) -> np.ndarray:
        """In how many of these documents each feature occurs."""
        return np.bincount(self._feature[documents[self._owner]], minlength=self.width)[:-1].astype(float)

    def _parts(self, chosen: np.ndarray) -> np.ndarray:
        """In how many abusive documents each feature occurs at chosen positions."""
        mine = chosen[self._positions]
        pairs = self._pairs(self._at[:, mine], self.text[self._positions[mine]], self.width)
        return np.bincount(pairs % self.width, minlength=self.width)[:-1].astype(float)

    def fit(self, corpus: np.ndarray, n_corpus: int, train: np.ndarray) -> Model:
        """A model of the training documents: first whole abusive documents, then the passages found in them, count as abusive text."""
        mine = self.abusive & train
        plain = self._whole(~self.abusive & train)
        model = Model(self.vocabulary, np.zeros(len(self.vocabulary), np.float32))
        yes, rest, passages = self._whole(mine), np.zeros(len(self.vocabulary)), int(mine.sum())
        for _ in range(ROUNDS):
            if not passages:
                break
            model = Model(self.vocabulary, log_odds(yes, plain + rest, corpus, passages, train.sum(), n_corpus))
            scores = np.zeros(len(self.text), np.float32)
            scores[self._positions] = model.positions(self.codes[:, self._positions])
            chosen = np.zeros(len(self.text), bool)
            passages = 0
            for d in np.flatnonzero(mine):
                s, e = self.begin[d], self.begin[d + 1]
                found = all_segments(scores[s:e], PASSAGE)
                passages += bool(found)
                for b, x, _ in found:
                    chosen[s + b : s + x] = True
            yes, rest = self._parts(chosen), self._parts(mine[self.text] & ~chosen)
        return model


def fit_model(sample: Labelled, corpus: np.ndarray, n_corpus: int, folds: int = 6) -> Model:
    """The model of the whole sample, its calibration and level taken from models that haven't seen the document.

    The Gumbel law is laid through the median and the upper decile of the plain documents' best scores, so a few wrong labels
    don't move it. The level is the p-value that separates the labels best (by F1).
    """
    model = sample.fit(corpus, n_corpus, np.ones(sample.documents, bool))
    fold = np.arange(sample.documents) % folds
    best = np.zeros(sample.documents)
    for k in range(folds):
        other = sample.fit(corpus, n_corpus, fold != k)
        found, _, _ = best_segments(other.positions(sample.codes), sample.text, sample.documents)
        best[fold == k] = found[fold == k]
    plain = best[~sample.abusive]
    if len(plain) and sample.abusive.any():
        low, high = np.quantile(plain, [0.5, 0.9])
        # quantiles of the Gumbel law: location - scale * ln(-ln q)
        model.scale = max((high - low) / (np.log(np.log(2)) - np.log(-np.log(0.9))), 0.25)
        model.location = low + model.scale * np.log(np.log(2))
        p = model.p_values(best, sample.lengths)
        order = np.argsort(p, kind="stable")
        right = np.cumsum(sample.abusive[order])
        f1 = 2 * right / (np.arange(1, len(p) + 1) + sample.abusive.sum())
        # between the last document that counts and the next one, on the scale of scores
        at = int(np.argmax(np.where(p[order] < 0.5, f1, 0)))
        after = p[order[min(at + 1, len(p) - 1)]]
        model.level = float(np.sqrt(max(p[order[at]], 1e-300) * max(after, 1e-300)))
    return model


def score_documents(documents: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, carried: Sequence[str] = ()) -> DataFrame:
    """(`key`, `score`, `p_value`, `passages`, `abusive`) and the `carried` columns of every document.

    The model is fitted on at most LABELLED_DOCUMENTS labelled documents; its prior counts how many of all documents hold
    each of its features. Documents with contradictory labels take no part in the fit. A document's score is that of its
    best passage, its p-value the chance of such a passage in a plain document of its length, and `abusive` says
    whether that is below the level that separates the labels; `passages` counts all significant passages. NULL and empty
    texts score 0. Without labels of both kinds nothing is abusive. Rows without key are left out, repeats scored each.

    Every text is cut into words once; their codes are kept for counting, fitting and scoring. Only codes of the labelled sample come to the driver.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)
    kept = {f"_c{i}": c for i, c in enumerate(carried)}
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("_d"), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"), *[F.col(c).alias(a) for a, c in kept.items()])
    held = "".join(f", {a} {kind[c]}" for a, c in kept.items())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(w=word_codes(b["_t"].tolist()), known=b["_t"].notna()).drop(columns="_t")

    coded = cut_lineage(docs.mapInPandas(cut, f"_d {kind[key]}, _h long{held}, w array<int>, known boolean"))
    votes = labels.where(F.col(label_key).isNotNull() & F.col(label).isNotNull()).distinct().groupBy(F.col(label_key).alias("_k")).agg(F.avg(label).alias("_y")).where("_y <> 0.5")
    votes = votes.orderBy(F.xxhash64("_k"), "_k").limit(LABELLED_DOCUMENTS)
    chosen = coded.join(F.broadcast(votes), coded["_d"] == votes["_k"]).where("known").groupBy("_h").agg(F.min_by(F.struct("_d", "_y", "w"), "_d").alias("v"))
    known = chosen.select("v.*").orderBy("_d").toPandas()
    sample = Labelled([np.asarray(w, np.int32) for w in known["w"]], (known["_y"] > 0.5).to_numpy(bool))
    del known
    vocabulary = spark.sparkContext.broadcast(sample.vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = vocabulary.value
        total, n = np.zeros(len(words_of), np.int64), 0
        for b in batches:
            n += len(b)
            if not len(words_of):
                continue
            codes, text_no, _ = joined_features(b["w"].tolist())
            texts, places = [], []
            for c in codes:
                at = np.minimum(np.searchsorted(words_of, c), len(words_of) - 1)
                hit = words_of[at] == c
                texts.append(text_no[hit])
                places.append(at[hit])
            pairs = distinct_pairs(np.concatenate(texts), np.concatenate(places), len(words_of))
            total += np.bincount(pairs % pairs.dtype.type(len(words_of)), minlength=len(words_of))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": np.r_[-1, at], "n": np.r_[n, total[at]]})

    counted = coded.where("known").select("w").mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    corpus, n_corpus = np.zeros(len(sample.vocabulary)), 0
    for i, n in zip(counted["i"], counted["n"], strict=True):
        if i < 0:
            n_corpus = int(n)
        else:
            corpus[i] = n
    fitted = spark.sparkContext.broadcast(fit_model(sample, corpus, n_corpus))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fitted.value
        for b in batches:
            codes, text_no, _ = joined_features(b["w"].tolist())
            scores = model.positions(codes)
            best, _, _ = best_segments(scores, text_no, len(b))
            lengths = np.bincount(text_no, minlength=len(b))
            p = model.p_values(best, lengths)
            abusive = p < model.level
            begin = np.r_[0, np.cumsum(lengths)]
            least = model.location + model.scale * -np.log(max(model.level, 1e-300))
            passages = [len(all_segments(scores[begin[i] : begin[i + 1]], max(least, 1e-9))) if abusive[i] else 0 for i in range(len(b))]
            yield b.drop(columns=["_h", "w", "known"]).assign(score=best, p_value=p, passages=passages, abusive=abusive)

    scored = coded.mapInPandas(scan, f"_d {kind[key]}{held}, score double, p_value double, passages int, abusive boolean")
    return scored.select(F.col("_d").alias(key), *[F.col(a).alias(c) for a, c in kept.items()], "score", "p_value", "passages", "abusive")
