"""Table access: plain parquet scans, so that filters and columns reach the reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

SESSION_TABLES = ("sample_cc_session", "emotional_session")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one table of a dataset folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def session_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of both session tables, with session_id, msg_id and parent_id in comparable form."""
    from lorebase.functions.messages import with_identifiers

    both = reduce(DataFrame.unionByName, (table(spark, root, name) for name in SESSION_TABLES))
    return with_identifiers(both)
