"""Queries of problem 7, most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.vectors import close_pairs, nearest
from lorebase.sources.tables import table


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("id", "embedding")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return close_pairs(_chunks(spark, root), "id", "embedding", None, 0.9, 10).select("id_a", "id_b")


def p7_nearest(spark: SparkSession, root: str) -> DataFrame:
    """Ten nearest chunks of every chunk whose id is divisible by 100, against all chunks."""
    return nearest(_chunks(spark, root), F.col("id") % 100 == 0, "id", "embedding", None, 10)


QUERIES = {f.__name__: f for f in (p7_found, p7_nearest)}
SQL = {
    "p7_found": """WITH v AS (SELECT id, embedding::DOUBLE[64] AS e FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT a.id AS x, b.id AS y, array_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT * FROM s WHERE s >= 0.9 - 1e-9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 6) DESC, y) <= 10)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM t""",
}
