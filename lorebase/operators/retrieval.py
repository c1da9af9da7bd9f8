"""Retrieval: vector and keyword arms, rank fusion, scoring, expansion and access tracking.

Arms end in ``orderBy.limit`` (TakeOrderedAndProject: every task keeps k rows), fusion works on those few rows, and the
expansion joins start from them, so only the two scans grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import all_terms, bm25, simple_tokens
from lorebase.functions.vectors import cosine_similarity, vector_literal

ARM = 20
RRF_K = 60
HALF_LIFE_DAYS = 180


def vector_arm(chunks: DataFrame, query: list[float], k: int = ARM, vector: str = "embedding") -> DataFrame:
    """(id, similarity, vector_rank): the k chunks most similar to the query vector; NULL vectors take no part."""
    scored = chunks.filter(F.col(vector).isNotNull()).select("id", cosine_similarity(F.col(vector), vector_literal(query)).alias("similarity")).filter("similarity IS NOT NULL")
    top = scored.orderBy(F.col("similarity").desc(), "id").limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")))


def keyword_arm(chunks: DataFrame, terms: list[str], k: int = ARM, text: str = "content") -> DataFrame:
    """(id, score, keyword_rank): the k chunks with all terms that BM25 ranks highest."""
    tokens = chunks.select("id", simple_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    scored = bm25(tokens, "tokens", terms).filter(all_terms(F.col("tokens"), terms)).select("id", "score")
    top = scored.orderBy(F.col("score").desc(), "id").limit(k)
    return top.withColumn("keyword_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Reciprocal rank fusion; an item that one arm lacks gets nothing from it."""
    both = vector.select("id", "vector_rank").join(keyword.select("id", "keyword_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.select("id", "vector_rank", "keyword_rank", part("vector_rank").alias("rrf_vector"), part("keyword_rank").alias("rrf_keyword")).withColumn("hybrid_score", F.col("rrf_vector") + F.col("rrf_keyword"))


def recency(created: Column, as_of: str) -> Column:
    """1 for now and later, falling hyperbolically with age in days; 0.5 if unknown."""
    days = (F.lit(as_of).cast("timestamp").cast("double") - created.cast("double")) / 86_400
    return F.coalesce(1 / (1 + F.greatest(days, F.lit(0.0)) / HALF_LIFE_DAYS), F.lit(0.5))


def significance(col: Column) -> Column:
    return F.coalesce(col, F.lit(3)) / 5


def score(fused: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """final_score = 0.6 fused rank (relative to the best) + 0.2 recency + 0.2 significance."""
    best = fused.agg(F.max("hybrid_score").alias("best"))
    parts = fused.join(F.broadcast(best), F.lit(True)).join(chunks.select("id", "created_at", "significance"), "id")
    parts = parts.withColumns({"recency_score": recency(F.col("created_at"), as_of), "significance_score": significance(F.col("significance"))})
    total = 0.6 * F.when(F.col("best") > 0, F.col("hybrid_score") / F.col("best")).otherwise(0.0) + 0.2 * F.col("recency_score") + 0.2 * F.col("significance_score")
    return parts.withColumn("final_score", total).drop("best", "created_at", "significance")


def recall(chunks: DataFrame, query: list[float], terms: list[str] | DataFrame, as_of: str, limit: int = 10, chunk_type: str | None = None) -> DataFrame:
    """Hybrid recall. No vector: keywords alone; no terms: the vector alone; limit is clamped to 1..50.

    terms may be the keyword arm itself (id, keyword_rank), as an index gives it; then the chunks' texts are not read.
    """
    if chunk_type is not None:
        chunks = chunks.filter(F.col("chunk_type") == chunk_type)
    words = terms if isinstance(terms, DataFrame) else keyword_arm(chunks, terms)
    fused = fuse(vector_arm(chunks, query) if query else vector_arm(chunks.limit(0), [0.0]), words)
    ranked = score(fused, chunks, as_of)
    return ranked.orderBy(F.col("final_score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), "id").limit(max(1, min(50, limit)))


def expand_entities(hits: DataFrame, entity_chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, name, entity_type) for the entities linked to recalled chunks."""
    linked = entity_chunks.join(F.broadcast(hits.select(F.col("id").alias("chunk_id"))), "chunk_id")  # at most 50 hits
    return linked.join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id").select("chunk_id", "entity_id", "name", "entity_type")


def expand_messages(spans: DataFrame, messages: DataFrame, most: int = 100) -> DataFrame:
    """Messages inside the ordinal span of each chunk, the first most of a chunk.

    spans: chunk_id, session_id, start_ordinal, end_ordinal. The span becomes places, so the join is an equi join.
    """
    places = spans.select("chunk_id", "session_id", "start_ordinal", F.explode(F.sequence("start_ordinal", F.least("end_ordinal", F.col("start_ordinal") + most - 1))).alias("ordinal"))
    return places.join(messages, ["session_id", "ordinal"])


def batch_top(chunks: DataFrame, queries: dict[int, list[float]], k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, place) for a stated set of query vectors: one pass, one matrix product per batch."""
    names = np.array(list(queries), dtype=np.int64)
    asked = np.array(list(queries.values()), dtype=np.float64)
    asked = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    size = asked.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vector].to_numpy()).astype(np.float64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = asked @ x.T
            near[names[:, None] == b["id"].to_numpy()[None, :]] = -np.inf  # a vector is no neighbour of its own
            take = min(k, near.shape[1])
            best = np.argpartition(-near, take - 1, axis=1)[:, :take]
            rows = np.repeat(np.arange(len(names)), take)
            yield pd.DataFrame({"query_id": names[rows], "id": b["id"].to_numpy()[best.ravel()], "similarity": near[rows, best.ravel()]})

    usable = chunks.filter((F.size(vector) == size) & ~F.exists(vector, lambda v: v.isNull()) & F.exists(vector, lambda v: v != 0)).select("id", vector)
    local = usable.mapInPandas(run, "query_id long, id long, similarity double").filter("similarity > -2")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id"))
    return local.withColumn("place", place).filter(F.col("place") <= k)


def access_log(hits: DataFrame, entity_chunks: DataFrame, at: str) -> DataFrame:
    """Append-only access events (kind, id, accessed_at) of recalled chunks and their entities."""
    stamp = F.lit(at).cast("timestamp").alias("accessed_at")
    chunks = hits.select(F.lit("chunk").alias("kind"), "id", stamp)
    touched = entity_chunks.join(F.broadcast(hits.select(F.col("id").alias("chunk_id"))), "chunk_id").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), stamp).distinct()
    return chunks.unionByName(touched)


def access_counts(base: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """Latest view of a table's access_count and last_accessed_at after its log."""
    events = log.filter(F.col("kind") == kind).groupBy("id").agg(F.count("*").alias("n"), F.max("accessed_at").alias("seen"))
    out = base.join(events, "id", "left")
    return out.withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "seen")}).drop("n", "seen")
