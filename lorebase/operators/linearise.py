"""Messages in the order of their reply tree: depth first, siblings by time, without sidechains and what hangs below them.

The forest of a session is walked inside a task over narrow rows; sessions above ``task_rows`` records are ordered by
joins: pointer doubling along the parents, then list ranking of the tour that enters and leaves every record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.ordinals import running_sum
from lorebase.session import cut

TASK_ROWS = 2_000_000
EARLIEST = -(1 << 62)


def walk(node: np.ndarray, parent: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of each node in the depth-first walk over all roots by number; -1 on and below sidechains.

    parent is -1 for none. A loop is cut at its smallest node, which becomes a root.
    """
    n = len(node)
    order = np.argsort(node)
    node, parent, side, at = node[order], parent[order], side[order], at[order]
    found = np.searchsorted(node, parent).clip(0, max(n - 1, 0))
    up = np.append(np.where((parent >= 0) & (node[found] == parent), found, n), n)
    rounds = max(n, 2).bit_length() + 1
    least, jump = up.copy(), up.copy()
    for _ in range(rounds):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    up[:n][least[:n] == np.arange(n)] = n
    off, jump = np.append(side, False), up.copy()
    for _ in range(rounds):
        off, jump = off | off[jump], jump[jump]
    live = np.flatnonzero(~off[:n])
    below = live[up[live] < n]
    below = below[np.lexsort((below, at[below], up[below]))]
    first, following = np.full(n, -1), np.full(n, -1)
    if len(below):
        opens = np.append(True, up[below[1:]] != up[below[:-1]])
        first[up[below[opens]]] = below[opens]
        following[below[:-1][~opens[1:]]] = below[1:][~opens[1:]]
    ups, firsts, followings, place, k = up.tolist(), first.tolist(), following.tolist(), [-1] * n, 0
    for root in live[up[live] == n].tolist():
        v = root
        while v < n:
            place[v], k = k, k + 1
            if firsts[v] >= 0:
                v = firsts[v]
                continue
            while v < n and followings[v] < 0:
                v = ups[v]
            if v < n:
                v = followings[v]
    out = np.empty(n, np.int64)
    out[order] = place
    return out


def _walk_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    place = walk(whole["rec_id"].to_numpy(), whole["parent_rec"].fill_null(-1).to_numpy(), whole["side"].to_numpy(zero_copy_only=False), whole["at"].to_numpy())
    yield from whole.select(["session_id", "own"]).append_column("place", pa.array(place)).to_batches()


def _doubled(state: DataFrame, link: str, merged: dict) -> DataFrame:
    """state(id, link, ...) after following link to its end; merged: new columns from the own ones and those at the link, named x_."""
    for _ in range(max(state.count(), 2).bit_length() + 1):
        if state.filter(F.col(link).isNotNull()).isEmpty():
            break
        there = state.select(F.col("id").alias(link), F.col(link).alias("__next"), *(F.col(c).alias(f"x_{c}") for c in merged))
        state = cut(state.join(there, link, "left").select("id", F.col("__next").alias(link), *(e.alias(c) for c, e in merged.items())))
    return state


def _places_by_joins(nodes: DataFrame) -> DataFrame:
    nodes = cut(nodes)
    up = F.col("parent_rec").alias("up")
    least = _doubled(nodes.select(F.col("rec_id").alias("id"), up, F.col("parent_rec").alias("least")), "up", {"least": F.least("least", "x_least")})
    heads = least.filter("least = id").select(F.col("id").alias("rec_id"), F.lit(True).alias("head"))
    forest = cut(nodes.join(heads, "rec_id", "left").withColumn("parent_rec", F.when(F.col("head").isNull(), F.col("parent_rec"))).drop("head"))
    off = _doubled(forest.select(F.col("rec_id").alias("id"), up, "side"), "up", {"side": F.col("side") | F.coalesce("x_side", F.lit(False))})
    live = cut(forest.join(off.filter("NOT side").select(F.col("id").alias("rec_id")), "rec_id", "left_semi"))
    # roots are no siblings here, so that a session of many beginnings is not ordered in one task
    below = live.filter("parent_rec IS NOT NULL").withColumn("following", F.lead("rec_id").over(Window.partitionBy("parent_rec").orderBy("at", "rec_id")))
    every = below.unionByName(live.filter("parent_rec IS NULL").withColumn("following", F.lit(None).cast("long")))
    first = below.groupBy(F.col("parent_rec").alias("rec_id")).agg(F.min(F.struct("at", "rec_id"))["rec_id"].alias("first"))
    tour = every.select("rec_id", "parent_rec", "following").join(first, "rec_id", "left")
    enter, leave = F.col("rec_id") * 2, F.col("rec_id") * 2 + 1
    steps = tour.select(F.explode(F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"), F.lit(1).cast("long").alias("left"), enter.alias("last")),
        F.struct(leave.alias("id"), F.coalesce(F.col("following") * 2, F.col("parent_rec") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("left"), leave.alias("last")),
    )).alias("s")).select("s.*")
    ranked = _doubled(cut(steps), "next", {"left": F.col("left") + F.coalesce("x_left", F.lit(0)), "last": F.coalesce("x_last", "last")})
    entered = ranked.filter("id % 2 = 0").select(F.shiftright("id", 1).alias("rec_id"), F.shiftright("last", 1).alias("root"), "left").join(live.select("rec_id", "session_id", "own"), "rec_id")
    trees = entered.filter("rec_id = root").select("session_id", "root", F.col("left").alias("size"))
    ends = running_sum(trees, ["session_id"], "root", "size", "end").select("root", "end")
    return entered.join(ends, "root").select("session_id", "own", (F.col("end") - F.col("left")).alias("place"))


def reply_places(nodes: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(session_id, own, place): place rises along the walk of each session; records on and below sidechains are left out.

    nodes: rec_id (unique, not negative), session_id, own, parent_rec (a rec_id of the same session or null), side, at
    (whole number, not null). Roots come by rec_id, children by at, then rec_id.
    """
    columns = ["rec_id", "session_id", "own", "parent_rec", "side", "at"]
    narrow = cut(nodes.select(columns))
    inside = lambda rows: rows.repartition("session_id").mapInArrow(_walk_partition, "session_id string, own string, place long").filter("place >= 0")
    large = cut(narrow.groupBy("session_id").count().filter(F.col("count") >= task_rows).select("session_id"))
    if large.isEmpty():
        return inside(narrow)
    small = narrow.join(large, "session_id", "left_anti").select(columns)
    return inside(small).unionByName(_places_by_joins(narrow.join(large, "session_id", "left_semi").select(columns)))
