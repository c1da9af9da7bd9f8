"""Queries that run a stream over a table and read what it landed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import shared_folder
from lorebase.streaming import ingest as S


def _landed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(spark, name)
    S.land(stream, f"{folder}/rows", f"{folder}/state")
    return spark.read.parquet(f"{folder}/rows")


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Hourly counts by type as the stream last updated them; windows the watermark has not passed yet are there as well."""
    folder = shared_folder(spark, "windows")
    S.land_latest(S.windowed(S.event_stream(spark, root)).select(F.col("window.start").alias("started"), "event_type", "n", "total"), f"{folder}/rows", f"{folder}/state")
    rows = S.latest(spark.read.parquet(f"{folder}/rows"), ["started", "event_type"])
    return rows.select("started", "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that ended more than a day before the newest event, which no late row can change any more."""
    rows = _landed(spark, S.sessions(S.event_stream(spark, root)), "sessions")
    return rows.select("user_id", F.col("session_window.start").alias("started"), "n")


def stream_deduplicated(spark: SparkSession, root: str) -> DataFrame:
    twice = S.event_stream(spark, root).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _landed(spark, S.delivered_once(twice, "event_id"), "once").groupBy("event_type").agg(F.count("*").alias("n"))


def batch_windows(spark: SparkSession, root: str) -> DataFrame:
    """The windows of the stream as a batch, all of them."""
    rows = spark.read.schema(S.EVENTS).parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("started"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_deduplicated, batch_windows)}

SQL = {
    "stream_windows": "SELECT date_trunc('hour', ts) AT TIME ZONE 'UTC' AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT user_id, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, a AT TIME ZONE 'UTC' AS started, n FROM t WHERE b + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_deduplicated": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "batch_windows": "SELECT date_trunc('hour', ts) AT TIME ZONE 'UTC' AS started, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
