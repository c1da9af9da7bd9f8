"""Queries of problem 3, one ranking from four scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.borda import borda, ranking
from lorebase.sources.tables import table

SCORES = {"vector_similarity": 1.0, "keyword_score": 1.0, "significance": 1.0, "created_at": 1.0}


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """Distinct candidates first, then the two scores the chunk itself has."""
    own = table(spark, root, "recall_candidates").select("query_id", "chunk_id", "vector_similarity", "keyword_score").distinct()
    chunks = table(spark, root, "chunks").select(F.col("id").alias("chunk_id"), "significance", "created_at")
    return own.join(chunks, "chunk_id", "left")


def scored(spark: SparkSession, root: str) -> DataFrame:
    return borda(candidates(spark, root), ["query_id"], "chunk_id", SCORES)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    top = reduce(lambda a, b: a & b, (F.col(s).isNotNull() & (F.col(f"better_{s}") <= 2) for s in SCORES))
    return scored(spark, root).filter(top).select("query_id", "chunk_id").distinct()


def p3_ranking(spark: SparkSession, root: str) -> DataFrame:
    return ranking(scored(spark, root), ["query_id"], "chunk_id").select("query_id", "chunk_id", "points", F.col("place").cast("long"))


def p3_top10(spark: SparkSession, root: str) -> DataFrame:
    """Top ten of each query."""
    return ranking(scored(spark, root), ["query_id"], "chunk_id", 10).select("query_id", "chunk_id", "points", F.col("place").cast("long"))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranking, p3_top10)}

CANDIDATES = """c AS (SELECT DISTINCT r.query_id, r.chunk_id, CASE WHEN NOT isnan(r.vector_similarity) THEN r.vector_similarity END AS a, CASE WHEN NOT isnan(r.keyword_score) THEN r.keyword_score END AS b,
  k.significance::DOUBLE AS s, epoch_us(k.created_at)::DOUBLE AS t FROM recall_candidates r LEFT JOIN chunks k ON k.id = r.chunk_id)"""


def _rank(x: str) -> str:
    n = "count(*) OVER (PARTITION BY query_id)"
    return f"CASE WHEN {x} IS NULL THEN ({n} + 1) / 2.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY {x} DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {x}) - 1) / 2.0 END"


POINTS = f"""WITH {CANDIDATES}, p AS (SELECT query_id, chunk_id, 4 * count(*) OVER (PARTITION BY query_id) - ({' + '.join(_rank(x) for x in 'abst')}) AS points FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS place FROM p)
SELECT query_id, chunk_id, points::DOUBLE AS points, place FROM o"""

SQL = {
    "p3_found": f"""WITH {CANDIDATES} SELECT DISTINCT query_id, chunk_id FROM (SELECT *, {', '.join(f'rank() OVER (PARTITION BY query_id ORDER BY {x} DESC NULLS LAST) AS r{x}' for x in 'abst')} FROM c)
WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND greatest(ra, rb, rs, rt) <= 3""",
    "p3_ranking": POINTS,
    "p3_top10": POINTS + " WHERE place <= 10",
}
