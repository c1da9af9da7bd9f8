"""Queries of problem 5, variant spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.names import resolved
from lorebase.sources.tables import table


def _clusters(spark: SparkSession, root: str) -> DataFrame:
    return resolved(table(spark, root, "entities").select("id", "name", "entity_type", "aliases"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    c = _clusters(spark, root)
    a, b = c.select(F.col("id").alias("id_a"), "cluster"), c.select(F.col("id").alias("id_b"), "cluster")
    return a.join(b, "cluster").filter("id_a < id_b").select("id_a", "id_b")


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    return _clusters(spark, root)


QUERIES = {f.__name__: f for f in (p5_found, p5_clusters)}
SQL: dict[str, str] = {}
