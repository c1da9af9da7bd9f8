"""Queries of problem 9, evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.leaks import cleaned, leaks
from lorebase.sources.tables import table


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "eval_items").select("item_id", "passage"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id", F.col("longest").cast("long"), F.col("covered").cast("long"))


def p9_cleaned(spark: SparkSession, root: str) -> DataFrame:
    return cleaned(table(spark, root, "documents").select("doc_id", "text"), _leaks(spark, root))


QUERIES = {f.__name__: f for f in (p9_found, p9_spans, p9_cleaned)}

_GRAMS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
a AS (SELECT doc_id, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM w)),
b AS (SELECT item_id, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM v))"""

SQL = {
    "p9_found": _GRAMS + " SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)",
    "p9_spans": _GRAMS.replace("AS g FROM (SELECT doc_id", "AS g, i FROM (SELECT doc_id") + """, m AS (SELECT DISTINCT doc_id, item_id, i FROM a JOIN (SELECT DISTINCT item_id, g FROM b) USING (g)),
f AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) <= 10 THEN 0 ELSE 1 END AS opens FROM m), k AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM f),
s AS (SELECT doc_id, item_id, max(i) + 10 - min(i) AS size FROM k GROUP BY doc_id, item_id, n) SELECT doc_id, item_id, max(size) AS longest, sum(size)::BIGINT AS covered FROM s GROUP BY 1, 2""",
}
