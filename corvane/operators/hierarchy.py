"""Parent-child links of unknown depth: roots, depths, circles, paths and descendants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

#: Links that one local forest holds at most; a larger partition is made into several forests.
FOREST_ROWS = 200_000
_FRAGMENT = "id string, anc string, off int, low string, state string"


def clean_links(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(`id`, `up`) in lower case, one row per node, `up` NULL where it is NULL or names no node.

    Rows without node id are left out. A node with several different links keeps the smallest that
    isn't NULL. Only these two columns are read.
    """
    ids = df.select(F.lower(node).alias("id"), F.lower(parent).alias("up")).where("id is not null")
    one = ids.groupBy("id").agg(F.min("up").alias("up"))
    known = one.select(F.col("id").alias("_known"))
    return one.join(known, one["up"] == known["_known"], "left").select("id", F.col("_known").alias("up"))


def _compress(ids: np.ndarray, ups: np.ndarray) -> pd.DataFrame:
    """One weighted forest: each node with its highest ancestor among these links, the offset to it and the smallest id before it.

    state: R the ancestor is a root, O its link is held elsewhere, C the node leads into a circle
    (then anc is the smallest id of the circle).
    """
    n = len(ids)
    has = ~pd.isna(ups)
    names = np.unique(np.concatenate([ids, ups[has]]).astype(object))  # sorted: the number of a node orders like its id
    at = pd.Series(np.arange(len(names)), index=names)
    me, m = at.loc[ids].to_numpy(), len(names)
    jump = np.arange(m)
    jump[me[has]] = at.loc[ups[has]].to_numpy()
    moves = np.zeros(m, bool)
    moves[me[has]] = True
    off, low = moves.astype(np.int64), np.where(moves, np.arange(m), m)
    for _ in range(max(1, int(m).bit_length()) + 1):  # path halving, all nodes at once
        low = np.minimum(low, low[jump])
        off = off + off[jump]
        jump = jump[jump]
    circle = moves[jump]  # a node that never came to rest
    rooted = np.zeros(m, bool)
    rooted[me[~has]] = True
    state = np.where(circle[me], "C", np.where(rooted[jump[me]], "R", "O"))
    anc = np.where(circle[me], low[jump[me]], jump[me])
    return pd.DataFrame({"id": ids, "anc": names[anc] if n else [], "off": np.where(circle[me], -1, off[me]).astype(np.int32), "low": names[np.where(low[me] < m, low[me], me)] if n else [], "state": state})


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= FOREST_ROWS:
            yield _forest(held)
            held = []
    if held:
        yield _forest(held)


def _forest(held: list[pd.DataFrame]) -> pd.DataFrame:
    links = pd.concat(held)
    return _compress(links["id"].to_numpy(object), links["up"].to_numpy(object))


def _climb(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Open rows moved on to where the fragment of their ancestor ends; the others as they are.

    Only open rows are joined: closed ones all name a root, so a large tree would be one key.
    """
    t = index.select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("off").alias("t_off"), F.col("low").alias("t_low"), F.col("state").alias("t_state"))
    moved = rows.where("state = 'O'").join(t, F.col("anc") == F.col("t_id"), "left").select(
        "id", F.col("t_anc").alias("anc"), F.when(F.col("t_state") == "C", F.lit(-1)).otherwise(F.col("off") + F.col("t_off")).cast("int").alias("off"), F.least("low", "t_low").alias("low"), F.col("t_state").alias("state")
    )
    return rows.where("state <> 'O'").select(*moved.columns).unionByName(moved)


def resolve_forest(links: DataFrame) -> DataFrame:
    """(`id`, `root`, `depth`, `circular`) for each row of `links` (`id` unique, `up` NULL or another row's id).

    A node without link is its own root at depth 0. For a node on a circle or leading into one,
    depth is -1, `root` the smallest id on that circle and `circular` true.

    Each partition first compresses its own links into weighted forests. Of these only the ends
    whose link lies in another partition go on (the frontier). Frontier fragments are merged in a
    binary hierarchy: after k merges a fragment spans 2^k of the first ones, so a path of any
    length is done after about log2(length) joins. What is still open when the span exceeds the
    frontier runs in a circle. Nothing is gathered in one place; each merge is written to the
    shared checkpoint folder.
    """
    fragments = cut_lineage(links.mapInPandas(_local_forests, _FRAGMENT))
    ends = fragments.where("state = 'O'").select(F.col("anc").alias("id")).distinct()
    frontier = cut_lineage(fragments.join(ends, "id", "left_semi"))
    size, span = frontier.count(), 1
    while span <= 2 * size and not frontier.where("state = 'O'").isEmpty():
        frontier, span = cut_lineage(_climb(frontier, frontier)), span * 2
    low = frontier.select(F.col("id").alias("_at"), F.col("low").alias("_low"))
    f = frontier.join(low, (frontier["state"] == "O") & (frontier["anc"] == low["_at"]), "left")  # an end this far up lies on the circle
    circle = F.col("state") == "O"
    closed = f.select("id", F.when(circle, F.col("_low")).otherwise(F.col("anc")).alias("anc"), F.when(circle, F.lit(-1)).otherwise(F.col("off")).cast("int").alias("off"), "low", F.when(circle, F.lit("C")).otherwise(F.col("state")).alias("state"))
    done = _climb(fragments, closed)
    return done.select("id", F.col("anc").alias("root"), F.col("off").alias("depth"), (F.col("state") == "C").alias("circular"))


def materialise_paths(links: DataFrame, forest: DataFrame) -> DataFrame:
    """(`id`, `path`): the ids from the root down to the node, for all nodes outside circles.

    The parent index (id -> parents known so far) is looked up by the topmost known parent, which
    doubles the known part each time: log2(depth) joins, not one per level.
    """
    sound = links.join(forest.where("not circular").select("id", "depth"), "id")
    known = cut_lineage(sound.select("id", "depth", F.when(F.col("up").isNull(), F.array("id")).otherwise(F.array("up", "id")).alias("path")))
    while not known.where(F.size("path") <= F.col("depth")).isEmpty():
        index = known.select(F.col("id").alias("_top"), F.slice("path", 1, F.size("path") - 1).alias("_above")).where(F.size("_above") > 0)
        joined = known.join(index, (F.size("path") <= F.col("depth")) & (F.col("path")[0] == F.col("_top")), "left")
        known = cut_lineage(joined.select("id", "depth", F.concat(F.coalesce("_above", F.array().cast("array<string>")), "path").alias("path")))
    return known.select("id", "path")


def descendants(paths: DataFrame) -> DataFrame:
    """(`ancestor`, `id`, `distance`): every node under each node, itself excluded."""
    above = paths.select("id", F.posexplode("path").alias("_at", "ancestor"), F.size("path").alias("_n"))
    return above.where(F.col("_at") < F.col("_n") - 1).select("ancestor", "id", (F.col("_n") - 1 - F.col("_at")).cast("int").alias("distance"))
