"""Conversations rebuilt from loose message rows.

Records are linked to the record their parent identifier names; connected components of these links (large-star and
small-star joins) give the threads, and for records without a session identifier the conversation itself. A component
in which as many records have a parent as there are records contains a loop. Whether a turn was answered is found by
pointer doubling along the parent links: inside a task for components up to ``task_rows`` records, by joins beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.messages import content_text, not_blank, parsed, with_identifiers
from lorebase.llm.components import connected_components
from lorebase.operators.dedupe import first_copies
from lorebase.session import cut

TASK_ROWS = 4_000_000  # components of as many records are folded by joins; the result is the same for any number
PART_ROWS = 2_000_000  # records a task holds beside its largest component


def speaking(rows: DataFrame) -> DataFrame:
    """Narrow records: rec_id, session_id, msg_id, parent_id, flags unreadable, asks, answers, said, and the time."""
    main = ~F.coalesce("isSidechain", F.lit(False))
    has = rows.withColumn("__v", F.when(F.col("message").isNotNull(), parsed("message")))
    has = has.withColumn("__text", F.col("type").isin("user", "assistant") & main & not_blank(content_text("__v")))
    return has.select(
        "rec_id", "session_id", "msg_id", "parent_id",
        (F.col("message").isNotNull() & F.col("__v").isNull()).alias("unreadable"),
        (F.col("__text") & (F.col("type") == "user")).alias("asks"),
        (F.col("__text") & (F.col("type") == "assistant")).alias("answers"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """One copy of each record with parent_rec, the rec_id its parent_id names in the same session, and dangling."""
    own = F.coalesce("msg_id", F.concat(F.lit("\0"), F.col("rec_id").cast("string")))
    keyed = rows.withColumns({"sid": F.coalesce("session_id", F.lit("")), "own": own})
    once = first_copies(keyed, ["sid", "own"], ["rec_id"])
    parents = once.filter("msg_id IS NOT NULL").select("sid", F.col("own").alias("parent_id"), F.col("rec_id").alias("parent_rec"))
    known = once.join(parents, ["sid", "parent_id"], "left")
    dangling = F.col("parent_id").isNotNull() & F.col("msg_id").isNotNull() & F.col("parent_rec").isNull()
    return known.withColumn("dangling", dangling).select("rec_id", "session_id", "parent_rec", "unreadable", "dangling", "asks", "answers")


def threads(links: DataFrame) -> DataFrame:
    """links with the component of each record; a record without links is its own."""
    edges = links.filter("parent_rec IS NOT NULL AND parent_rec <> rec_id").select(F.col("rec_id").alias("src"), F.col("parent_rec").alias("dst"), "session_id")
    found = connected_components(edges, F.xxhash64("session_id", F.shiftright("src", 20)))
    return links.join(found.withColumnRenamed("node", "rec_id"), "rec_id", "left").withColumn("component", F.coalesce("component", "rec_id"))


def fold_up(node: np.ndarray, parent: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node whether it or any node below it has the flag, and its depth (in a loop: some number of steps)."""
    n = len(node)
    order = np.argsort(node)
    at = np.searchsorted(node, parent, sorter=order).clip(0, max(n - 1, 0))
    up = np.where((parent >= 0) & (node[order[at]] == parent), order[at], n)
    up = np.append(up, n)
    has, depth = np.append(flag, False), np.append((up[:n] < n).astype(np.int64), 0)
    for _ in range(max(n, 2).bit_length() + 1):
        live = up[:n] < n
        if not live.any():
            break
        below = has.copy()
        np.logical_or.at(below, up[:n][live], has[:n][live])
        depth = depth + depth[up]
        has, up = below, up[up]
    return has[:n], depth[:n]


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    node, parent = whole["rec_id"].to_numpy(), whole["parent_rec"].fill_null(-1).to_numpy()
    has, depth = fold_up(node, parent, whole["answers"].to_numpy(zero_copy_only=False))
    out = whole.select(["rec_id", "session_id", "component", "asks"]).append_column("answered", pa.array(has)).append_column("depth", pa.array(depth))
    yield from out.to_batches()


FOLDED = "rec_id long, session_id string, component long, asks boolean, answered boolean, depth long"


def _fold_by_joins(rows: DataFrame) -> DataFrame:
    """The same for components no task should hold: pointer doubling by joins, log2(depth) rounds."""
    state = cut(rows.select("rec_id", "session_id", "component", "asks", F.col("answers").alias("answered"), F.col("parent_rec").alias("up"), F.when(F.col("parent_rec").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    for _ in range(max(state.count(), 2).bit_length() + 1):
        if state.filter("up IS NOT NULL").isEmpty():
            break
        below = state.filter("up IS NOT NULL AND answered").select(F.col("up").alias("rec_id"), F.lit(True).alias("b")).distinct()
        jump = state.select(F.col("rec_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = cut(
            state.join(below, "rec_id", "left").join(jump, "up", "left")
            .select("rec_id", "session_id", "component", "asks", (F.col("answered") | F.coalesce("b", F.lit(False))).alias("answered"), F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        )
    return state.drop("up")


def _parted(rows: DataFrame) -> DataFrame:
    """Whole components to a task, in as many tasks as keep them to about PART_ROWS records."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, "component")


def folded(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """rec_id, session_id, component, asks, answered (an answer lies below) and depth, for rows of threads()."""
    narrow = rows.select("rec_id", "session_id", "component", "parent_rec", "asks", "answers")
    # sizes come from the linked components alone; records without links are components of one
    large = rows.filter("component <> rec_id").groupBy("component").count().filter(F.col("count") >= task_rows).select("component")
    if large.isEmpty():
        return _parted(narrow).mapInArrow(_fold_partition, FOLDED)
    small = narrow.join(large, "component", "left_anti").select(narrow.columns)
    inside = _parted(small).mapInArrow(_fold_partition, FOLDED)
    return inside.unionByName(_fold_by_joins(narrow.join(large, "component", "left_semi")))


def judged(rows: DataFrame, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Conversations to drop (session_id, nameless, broken, empty, unanswered) and the threads of all records.

    rows: records with rec_id (unique), session_id, msg_id, parent_id, type, isSidechain and message. Null flags count
    as false, copies of one identifier as one, a null parent starts a thread. Records without session_id form one
    conversation per component, judged by the same rules; nameless is that component, and null for a session.
    Repeated rows, ties and empty tables are no special case; further columns are ignored.
    """
    base = cut(threads(linked(speaking(rows))))
    loops = base.groupBy("component").agg(F.count("*").alias("n"), F.count("parent_rec").alias("m"), F.min("session_id").alias("session_id")).filter("n = m")
    fold = folded(base, task_rows)
    false = F.lit(False)
    parts = [
        base.select("session_id", "component", (F.col("unreadable") | F.col("dangling")).alias("broken"), (F.col("asks") | F.col("answers")).alias("said"), false.alias("unanswered")),
        loops.select("session_id", "component", F.lit(True).alias("broken"), false.alias("said"), false.alias("unanswered")),
        fold.filter("asks AND NOT answered").select("session_id", "component", false.alias("broken"), false.alias("said"), F.lit(True).alias("unanswered")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("nameless", F.when(F.col("session_id").isNull(), F.col("component")))
    marks = every.groupBy("session_id", "nameless").agg(F.bool_or("broken").alias("broken"), (~F.bool_or("said")).alias("empty"), F.bool_or("unanswered").alias("unanswered"))
    return marks.filter("broken OR empty OR unanswered"), fold


def rebuilt(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Turns of the sound conversations: conversation, thread, depth, spoken_at, rec_id, speaker and text.

    Ordered by thread (its first record), depth below its start, time as far as it can be read, and arrival; so a
    reply never precedes what it answers. Records without session_id form one conversation per component.
    """
    dropped, fold = judged(rows, task_rows)
    # one key for both kinds, so that no join meets the nulls of the other kind in one task
    key = lambda column: F.coalesce("session_id", F.concat(F.lit("\0"), F.col(column).cast("string"))).alias("__key")
    sound = fold.select("rec_id", "component", "depth", key("component")).join(dropped.select(key("nameless")), "__key", "left_anti").drop("__key")
    texts = rows.filter(F.col("type").isin("user", "assistant")).withColumn("__v", parsed("message"))
    texts = texts.select("rec_id", "session_id", F.col("type").alias("speaker"), content_text("__v").alias("text"), F.expr("try_cast(timestamp AS timestamp)").alias("spoken_at"))
    turns = texts.filter(not_blank("text")).join(sound, "rec_id")
    name = F.coalesce("session_id", F.concat(F.lit("thread:"), F.col("component").cast("string")))
    return turns.select(name.alias("conversation"), F.col("component").alias("thread"), "depth", "spoken_at", "rec_id", "speaker", "text")
