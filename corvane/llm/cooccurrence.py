"""How often two items occur in the same record, and how far that exceeds chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from corvane.session import cut_lineage

#: Pair codes that are sorted in memory at a time before they leave a task as a run.
RUN_CODES = 2_000_000
#: Members of a record up to which its pairs are made in one piece; larger ones are split into blocks of this size.
BLOCK_MEMBERS = 1_000

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"


def _packed(df: DataFrame, name: str) -> Column:
    """A column of texts as bytes, those in the form of a UUID as its 16: less than half of what else is shuffled. Other types as they are.

    The first byte of other texts tells how many bytes stand before them, of which there are two where one would make 16.
    """
    c = F.col(name)
    if df.select(c).schema[0].dataType != StringType():
        return c
    tag = F.when(F.octet_length(c) == 15, F.lit(b"\1\0")).otherwise(F.lit(b"\0"))
    return F.when(c.rlike(_UUID), F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(F.concat(tag, c.cast("binary")))


def _unpacked(c: Column, df: DataFrame, name: str) -> Column:
    """The value of which `_packed` made `c`."""
    if df.select(F.col(name)).schema[0].dataType != StringType():
        return c
    digits = F.lower(F.hex(c))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    text = F.when(F.substring(c, 1, 1) == F.lit(b"\0"), F.substring(c, 2, 2**31 - 1)).otherwise(F.substring(c, 3, 2**31 - 1))
    return F.when(F.octet_length(c) == 16, F.concat_ws("-", *parts)).otherwise(text.cast("string"))


def _run_lengths(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of a sorted array with their summed counts."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(np.ones(len(codes), np.int64) if counts is None else counts, starts)


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])


def _pair_codes(low: np.ndarray, left: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Codes of all pairs within each run of equal `group`; of pairs of one side only if the group has but one side.

    Works by distance: members d places apart are compared for d = 1, 2, ... while any group is that long.
    """
    found = []
    for d in range(1, len(low)):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        a, b, mixed = low[:-d][same], low[d:][same], left[:-d][same] != left[d:][same]
        whole = left[:-d][same] == 2  # an unsplit group
        take = mixed | whole
        a, b = a[take], b[take]
        found.append((np.minimum(a, b) << 32) | np.maximum(a, b))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (code, count) from rows sorted by group; the last, perhaps cut, group of a batch is carried over."""
    held: list[np.ndarray] = []
    size, rest = 0, None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        group, side, code = now
        if not len(group):
            continue
        cut = np.searchsorted(group, group[-1])
        rest = [x[cut:] for x in now]
        held.append(_pair_codes(code[:cut], side[:cut], group[:cut]))
        size += len(held[-1])
        if size >= RUN_CODES:
            yield _batch(*_run_lengths(np.sort(np.concatenate(held))))
            held, size = [], 0
    if rest is not None:
        held.append(_pair_codes(rest[2], rest[1], rest[0]))
    if held:
        yield _batch(*_run_lengths(np.sort(np.concatenate(held))))


def _merged_runs(least: int):
    """Run-length sums over the sorted stream of a partition; a run cut by a batch's end is carried over."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_code, open_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            codes, n = _run_lengths(np.concatenate([open_code, batch.column(0).to_numpy()]), np.concatenate([open_n, batch.column(1).to_numpy()]))
            open_code, open_n = codes[-1:], n[-1:]
            keep = n[:-1] >= least
            yield _batch(codes[:-1][keep], n[:-1][keep])
        keep = open_n >= least
        yield _batch(open_code[keep], open_n[keep])

    return merge


def _numbered(df: DataFrame) -> DataFrame:
    """`df` with `_code`, numbers from 0 without gaps. Only the row count of each partition comes to the driver."""
    marked = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(part).agg(F.count("*")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if total >= 2**31:
        raise ValueError("more items than a 32-bit code can number")
    at = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    return marked.join(F.broadcast(at), part == F.col("_p")).withColumn("_code", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_start")


def _count_codes(light: DataFrame, heavy: DataFrame | None, least: int, block: int) -> DataFrame:
    """(`code`, `n` >= `least`) from (`_record`, `_code`) of records of at most `block` rows and (`_record`, `_code`, `_size` of the record) of the others.

    A record above `block` members is cut into blocks; each two blocks meet in a group of their own, so
    that no group exceeds about two blocks. Tasks sort their codes into runs; the shuffle's external
    sorter spills and merges the runs, and what comes out is counted by run length.
    """
    grouped = light.repartition("_record").distinct().sortWithinPartitions("_record", "_code")
    runs = grouped.select(_name(light), F.lit(2).cast("long").alias("side"), "_code").mapInArrow(_from_names(1), "code long, n long")
    if heavy is not None:
        blocks = F.ceil(F.col("_size") / block).cast("int")
        mine = F.pmod(F.xxhash64("_code"), blocks).cast("int")
        met = heavy.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        first, second = F.least("_b", "_o"), F.greatest("_b", "_o")
        side = F.when(F.col("_b") == F.col("_o"), F.lit(2)).otherwise((F.col("_b") > F.col("_o")).cast("int"))
        parts = met.select("_record", first.alias("_i"), second.alias("_j"), side.cast("long").alias("side"), "_code")
        parts = parts.repartition("_record", "_i", "_j").sortWithinPartitions("_record", "_i", "_j", "_code")
        runs = runs.unionByName(parts.select(_name(heavy), "_i", "_j", "side", "_code").mapInArrow(_from_names(3), "code long, n long"))
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged_runs(least), "code long, n long")


def _name(df: DataFrame) -> Column:
    """The record as bytes or as text, equal for equal records of any type."""
    return F.col("_record") if dict(df.dtypes)["_record"] == "binary" else F.col("_record").cast("string")


def _from_names(width: int):
    """The runs' maker for rows whose groups are named by the first `width` columns: neighbours of equal name get one number."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
            new = np.zeros(batch.num_rows, bool)
            for i, x in enumerate(names):
                new |= np.r_[last is None or x[0] != last[i], x[1:] != x[:-1]]
            group = number + np.cumsum(new)
            last, number = [x[-1] for x in names], int(group[-1])
            yield pa.RecordBatch.from_arrays([pa.array(group), batch.column(width), batch.column(width + 1)], names=["g", "side", "code"])

    return lambda batches: _sorted_runs(numbered(batches))


def association(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """The odds ratio of the fourfold table with 0.5 added to each cell, so that empty cells give finite values."""
    both, a, b = n_ab + 0.5, n_a - n_ab + 0.5, n_b - n_ab + 0.5
    return both * (n - n_a - n_b + n_ab + 0.5) / (a * b)


def items_together(df: DataFrame, record: str, item: str, least: int = 5, times: int = 10, block: int = BLOCK_MEMBERS) -> DataFrame:
    """(`item_a`, `item_b`, `n_ab`, `n_a`, `n_b`, `n`, `odds_ratio`): pairs of items in at least `least` common records and at least `times` as many as chance lets expect.

    n_ab * n >= times * n_a * n_b, with n the number of different records. Repeats of (record, item)
    count once, rows without record or item not at all (a record without items still counts in n).
    Pairs have the smaller item first. `least` is at least 1.

    Two bounds follow from these conditions and drop items before any pair is made, without losing
    a result: an item needs `least` records, and, as n_ab <= min(n_a, n_b), at most n / times of them.
    So an item that holds a third of all rows makes no pairs at all.

    In a record of more than `block` members, a pair needs `least` - 1 further common records, so each
    item leaves out its `least` - 1 largest such records when pairs are made; a pair that qualifies is
    still met in its smallest common record. What was left out is then counted for the pairs met.
    """
    rows = df.select(_packed(df, record).alias("_record"), _packed(df, item).alias("_item"))
    each = rows.where("_record is not null").groupBy("_record").agg(F.count("*").alias("_rows"))
    n, most = each.agg(F.count("*"), F.max("_rows")).first()
    stated = rows.where("_record is not null and _item is not null")
    known = stated.distinct().groupBy("_item").agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & (F.col("_n") * times <= n))
    items = _numbered(known)
    coded = lambda x: x.join(items.select("_item", "_code"), "_item").select("_record", "_code")
    if (most or 0) <= block:
        counted = _count_codes(coded(stated), None, least, block)
    else:
        # records of few rows need no sizes, and no task gets more than `block` rows of one of them
        large = cut_lineage(each.where(F.col("_rows") > block).select("_record"))
        light = coded(stated.join(large, "_record", "left_anti"))
        pairs = cut_lineage(coded(stated.join(large, "_record", "left_semi")).distinct())
        sized = cut_lineage(pairs.join(pairs.groupBy("_record").agg(F.count("*").alias("_size")), "_record"))
        heavy = sized.where(F.col("_size") > block)
        light = light.unionByName(sized.where(F.col("_size") <= block).select("_record", "_code"))
        if least < 2 or heavy.isEmpty():
            counted = _count_codes(light, heavy, least, block)
        else:
            order = Window.partitionBy("_code").orderBy(F.col("_size").desc(), F.col("_record").desc())
            left_out = cut_lineage(heavy.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") < least).select("_record", "_code"))
            made = heavy.join(left_out, ["_record", "_code"], "left_anti")
            counted = _with_left_out(cut_lineage(_count_codes(light, made, 1, block)), left_out, heavy.select("_record", "_code"), least)
    a, b = items.select(F.col("_code").alias("_a"), F.col("_item").alias("_item_a"), F.col("_n").alias("_n_a")), items.select(F.col("_code").alias("_b"), F.col("_item").alias("_item_b"), F.col("_n").alias("_n_b"))
    split = counted.select(F.shiftright("code", 32).alias("_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("_b"), F.col("n").alias("n_ab"))
    named = split.join(a, "_a").join(b, "_b").where(F.col("n_ab") * n >= F.lit(times) * F.col("_n_a") * F.col("_n_b"))
    for c in ("_item_a", "_item_b"):
        named = named.withColumn(c, _unpacked(F.col(c), df, item))
    swap = F.col("_item_a") > F.col("_item_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return named.select(
        pick("_item_a", "_item_b").alias("item_a"), pick("_item_b", "_item_a").alias("item_b"), "n_ab",
        pick("_n_a", "_n_b").alias("n_a"), pick("_n_b", "_n_a").alias("n_b"), F.lit(n).cast("long").alias("n"),
    ).withColumn("odds_ratio", association(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")))


def _with_left_out(counted: DataFrame, left_out: DataFrame, heavy: DataFrame, least: int) -> DataFrame:
    """Counts completed by the large records in which one of the two items took no part."""
    split = counted.select("code", F.shiftright("code", 32).alias("_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("_b"))
    by_a = split.join(left_out.withColumnRenamed("_code", "_a"), "_a").select("code", "_record", F.col("_b").alias("_code"))
    by_b = split.join(left_out.withColumnRenamed("_code", "_b"), "_b").select("code", "_record", F.col("_a").alias("_code"))
    more = by_a.unionByName(by_b).join(heavy, ["_record", "_code"], "left_semi").select("code", "_record").distinct().groupBy("code").agg(F.count("*").alias("_more"))
    return counted.join(more, "code", "left").select("code", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")).where(F.col("n") >= least)
