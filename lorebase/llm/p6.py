"""Queries of problem 6, personal information in messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.messages import content_text, parsed
from lorebase.llm.personal import kinds, redacted
from lorebase.sources.tables import session_rows


def texts(spark: SparkSession, root: str) -> DataFrame:
    rows = session_rows(spark, root).filter(F.col("type").isin("user", "assistant") & F.col("message").isNotNull())
    return rows.select("rec_id", parsed("message").alias("v")).select("rec_id", content_text("v").alias("text")).filter("text <> ''")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return kinds(texts(spark, root), "rec_id")


def p6_redacted(spark: SparkSession, root: str) -> DataFrame:
    return redacted(texts(spark, root), "rec_id")


QUERIES = {f.__name__: f for f in (p6_found, p6_redacted)}
SQL: dict[str, str] = {}
