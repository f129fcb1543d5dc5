"""Encoding of a corpus with a byte-level BPE vocabulary, whole partitions at a time."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: how the vocabulary's byte-level tokenizer cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are encoded together; what one task holds at a time.
CHUNK_CHARS = 8_000_000
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """The merge rules as sorted arrays: pairs (left << 32 | right), their ranks and the ids they make."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in rules], np.int64)
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        self.left = np.array([ids[a] for a, _ in rules], np.int32)
        self.right = np.array([ids[b] for _, b in rules], np.int32)
        self.made = np.array([ids[a + b] for a, b in rules], np.int32)
        self.first = np.array([ids[c] for c in _byte_signs()], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where there is no rule."""
        codes = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return np.where(self.pairs[at] == codes, self.order[at], _NONE).astype(np.int32)


def _byte_signs() -> list[str]:
    """The visible sign by which the vocabulary writes each byte: itself if printable in Latin-1, else the next free code from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and where each piece begins (with the end as last entry).

    The pair occurrence index maps each active rank to all positions at which its pair was seen. Ranks
    are applied in ascending order, each to all its positions at once; a rule's result can only be
    part of rules of higher rank, so every rank is final when its turn comes. A merge enters the pairs
    with both neighbours into the lists of their ranks; entries that a merge has made invalid are
    recognised when their rank is applied.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(text)
    sym = np.append(v.first[text], -1)  # the entry at n stands for no neighbour
    ends = np.cumsum(lengths)
    nxt = np.append(np.arange(1, n + 1), n)
    nxt[ends[lengths > 0] - 1] = n
    prv = np.append(np.arange(-1, n - 1), n)
    prv[(ends - lengths)[lengths > 0]] = n
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = v.ranks(sym[at], sym[nxt[at]])
        known = rank != _NONE
        at, rank = at[known], rank[known]
        if not len(at):
            return
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    every = np.arange(n)
    enter(every[nxt[:n] != n])
    while active:
        r = heapq.heappop(active)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[(sym[at] == v.left[r]) & (sym[nxt[at]] == v.right[r])]
        if not len(at):
            continue
        at = np.unique(at)
        if v.left[r] == v.right[r]:  # of a row of equal signs the first two merge, then the next two
            follows = np.r_[False, nxt[at[:-1]] == at[1:]]
            start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        sym[at], sym[gone] = v.made[r], -1
        nxt[at] = after
        prv[after] = at
        prv[n] = n
        before = prv[at]
        enter(np.concatenate([before[before != n], at[after != n]]))
    alive = sym[:n] >= 0
    before = np.r_[0, np.cumsum(alive)]
    return sym[:n][alive], before[np.r_[0, ends]]


def encode_texts(texts: list[str | None], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text begins. Equal pieces are encoded once."""
    import regex

    cut = regex.compile(PIECES).findall
    known: dict[str, int] = {}
    numbers = [[known.setdefault(p, len(known)) for p in cut(t)] if t else [] for t in texts]
    ids, begin = encode_pieces([p.encode() for p in known], v)
    each = np.fromiter((i for x in numbers for i in x), np.int64)
    size = np.diff(begin)[each]
    total = np.r_[0, np.cumsum(size)]
    flat = ids[np.repeat(begin[each] - total[:-1], size) + np.arange(total[-1])]
    return flat, total[np.r_[0, np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers)))]]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary_file: str) -> DataFrame:
    """(`key`, `ids`): the ids of each text, an empty list for NULL and ''; a special token's spelling is ordinary text.

    One row per row of `df`, repeats and NULL keys included. No shuffle: each task encodes its rows in
    chunks of bounded text (a longer text makes a chunk by itself). The rules, whose number is the
    vocabulary's, are broadcast once.
    """
    spark = df.sparkSession
    rules = spark.sparkContext.broadcast(Vocabulary(vocabulary_file))
    kind = df.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        texts: list[str | None] = []
        held = 0
        for batch in batches:
            for start, part in _by_size(batch.column(1).to_pylist(), CHUNK_CHARS):
                keys.append(batch.column(0).slice(start, len(part)))
                texts += part
                held += sum(len(t or "") for t in part)
                if held >= CHUNK_CHARS:
                    yield _encoded(keys, texts, rules.value)
                    keys, texts, held = [], [], 0
        if texts:
            yield _encoded(keys, texts, rules.value)

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return df.select(key, text).mapInArrow(encode, StructType([StructField(key, kind), StructField("ids", ArrayType(IntegerType()))]))


def _by_size(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of about `most` characters, each with its place."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _encoded(keys: list[pa.Array], texts: list[str | None], v: Vocabulary) -> pa.RecordBatch:
    ids, begin = encode_texts(texts, v)
    key = pa.concat_arrays(keys)
    return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))], names=["key", "ids"])


def decoder(vocabulary_file: str) -> Callable[[list[int]], str]:
    """The way back from ids to text, for round trips."""
    with open(vocabulary_file, encoding="utf-8") as f:
        ids: dict[str, int] = json.load(f)["model"]["vocab"]
    byte = {sign: b for b, sign in enumerate(_byte_signs())}
    back = {i: bytes(byte[c] for c in s) for s, i in ids.items() if all(c in byte for c in s)}
    return lambda x: b"".join(back[i] for i in x).decode()
