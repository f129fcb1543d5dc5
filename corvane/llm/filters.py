"""A filter of fixed size for membership in a distributed set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter; its size doesn't depend on the number of members.
BITS = 1 << 26
_CHUNK = 1 << 16


def filter_of(bits: DataFrame) -> Broadcast:
    """The broadcast filter of a column of numbers from 0 to BITS - 1: BITS / 8 bytes at most, however many rows there are."""

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(_CHUNK, np.uint8)
        flags[b["bit"].to_numpy() % _CHUNK] = 1
        return pd.DataFrame({"chunk": [int(b["bit"].iloc[0]) // _CHUNK], "bits": [np.packbits(flags).tobytes()]})

    packed = bits.toDF("bit").distinct().groupBy(F.floor(F.col("bit") / _CHUNK)).applyInPandas(pack, "chunk long, bits binary")
    whole = np.zeros(BITS // 8, np.uint8)
    for row in packed.collect():
        whole[row["chunk"] * _CHUNK // 8 : (row["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits.sparkSession.sparkContext.broadcast(whole)


def passes(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members."""
    bit = hashes.view(np.int64) & (BITS - 1)
    return (whole[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def text_hashes(values: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(v) for v in values), np.uint64, len(values))


def text_filter(values: DataFrame, hashes: Callable[[list[str]], np.ndarray] = text_hashes) -> Broadcast:
    """The filter of a column of texts."""

    def bit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bit": (hashes(b.iloc[:, 0].tolist()).view(np.int64) % BITS).astype(np.int64)})

    return filter_of(values.mapInPandas(bit, "bit long"))
