"""Incremental ingestion with Structured Streaming: file sources, deduplication, windows, sessions, and layer tables.

Every stream writes files with its own checkpoint, so it can be stopped, lose executors, and go on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """Stream of the events table's files, with ts as a timestamp (a watermark needs one)."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(root)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of session-log lines; new files below folder are picked up as they come."""
    rows = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    return rows.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; rows later than late behind the newest are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Activity of each user, cut after gap without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def delivered_once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """One row of each key within the watermark; the state of older keys is forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, last_ts) after each batch, kept per user in custom state."""

    def fold(key, batches, state):
        n, last = state.get if state.exists else (0, None)
        for b in batches:
            n += len(b)
            newest = b["ts"].max().to_pydatetime()
            last = newest if last is None or newest > last else last
        state.update((n, last))
        import pandas as pd

        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [last]})

    out = "user_id long, n long, last_ts timestamp"
    kept = T.StructType([T.StructField("n", T.LongType()), T.StructField("last_ts", T.TimestampType())])
    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(fold, out, kept, "update", "NoTimeout")


def land_latest(stream: DataFrame, out: str, state: str) -> None:
    """Run a stream of updates over everything there is now; out gets every batch's rows with its number (batch)."""

    def append(rows: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces its own rows
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    land_batches(stream, append, state, "update")


def latest(landed: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of what land_latest wrote, open windows included."""
    rest = [c for c in landed.columns if c not in (*keys, "batch")]
    newest = landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return newest.select(*keys, "__row.*")


def land(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Run the stream over everything there is now, append its rows to out, and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def land_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """The same with a function for each batch, such as an anti-join with what is stored and an append."""
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
