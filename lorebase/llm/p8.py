"""Queries of problem 8, documents in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.packing import CAPACITY, packed, pieces, token_counts
from lorebase.session import cut
from lorebase.sources.tables import table


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container of every document or piece of one."""
    sizes = token_counts(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text")
    return packed(cut(pieces(sizes, "doc_id", CAPACITY)), "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, the tokens in them and the share of their capacity that is used."""
    per = p8_containers(spark, root).groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("fill"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill)}
SQL: dict[str, str] = {}
