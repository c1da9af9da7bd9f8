"""Composed reads: recall with its depths, entities by name or number, searches over an index that is built once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import all_terms, bm25, english_terms, english_tokens
from lorebase.operators.graph import active, induced, neighbourhood
from lorebase.operators.retrieval import access_log, expand_entities, expand_messages, recall
from lorebase.session import cut

TERM_BUCKETS = 256
POSTING = "term string, id long, tf int, n_terms int"


def clamped(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def _part(rows: DataFrame, item: str, ref, detail) -> DataFrame:
    return rows.select("chunk_id", F.lit(item).alias("item"), ref.cast("long").alias("ref"), detail.cast("string").alias("detail"))


def recall_report(hits: DataFrame, depth: int, chunks: DataFrame, entity_chunks: DataFrame, entities: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(chunk_id, item, ref, detail) for recalled chunks: their entities; from depth 2 the text and the conversation; at
    depth 3 the messages, a hundred a chunk at most. depth is clamped to 1..3; everything starts from the few hits."""
    depth = clamped(depth, 1, 3)
    few = F.broadcast(hits.select(F.col("id").alias("chunk_id")))  # at most 50
    out = _part(expand_entities(hits, entity_chunks, entities), "entity", F.col("entity_id"), F.col("name"))
    if depth > 1:
        own = chunks.select(F.col("id").alias("chunk_id"), "conversation_id", "content", F.col("start_ordinal").cast("long"), F.col("end_ordinal").cast("long")).join(few, "chunk_id")
        talks = conversations.select(F.col("id").alias("conversation_id"), "session_id", F.col("name").alias("title"))
        met = own.join(talks, "conversation_id")
        out = out.unionByName(_part(own, "content", F.col("start_ordinal"), F.col("content"))).unionByName(_part(met, "conversation", F.col("conversation_id"), F.col("title")))
        if depth > 2:
            said = expand_messages(met.filter("start_ordinal <= end_ordinal").select("chunk_id", "session_id", "start_ordinal", "end_ordinal"), messages)
            out = out.unionByName(_part(said, "message", F.col("rec_id"), F.col("role")))
    return out


def recalled(spark: SparkSession, index: str, query: str, vector: list[float], depth: int, as_of: str, tables: Mapping[str, DataFrame], limit: int = 10, chunk_type: str | None = None, buckets: int = TERM_BUCKETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recall as one call: the hits, what recall_report tells of them at the depth, and the access events to append.

    index: folder of build_postings over the chunks. tables: chunks, entity_chunks, entities, conversations, messages. With a
    chunk_type the index is asked for all matches, as it does not hold types, and the best twenty of the type are taken.
    """
    chunks = tables["chunks"]
    matches = match_postings(spark, index, query, buckets)
    if chunk_type is not None:
        matches = matches.join(chunks.filter(F.col("chunk_type") == chunk_type).select("id"), "id")
    words = _ranked(matches, 20)
    hits = cut(recall(chunks, vector, words, as_of, limit, chunk_type))
    report = recall_report(hits, depth, chunks, tables["entity_chunks"], tables["entities"], tables["conversations"], tables["messages"])
    return hits, report, access_log(hits, tables["entity_chunks"], as_of)


def resolved_entity(entities: DataFrame, asked: str, by: str = "access_count") -> DataFrame:
    """The one entity that is asked for: by number if the text is one and an entity has it, else by part of its name in
    any case, the exact name first, then the most used. Blank text and no match give no row."""
    asked = asked.strip()
    if not asked:
        return entities.limit(0)
    number = int(asked) if asked.isdigit() and len(asked) < 19 else None
    place = F.when(F.col("id") == number, 0).when(F.lower("name") == asked.lower(), 1).when(F.lower("name").contains(asked.lower()), 2)
    return entities.withColumn("__place", place).filter("__place IS NOT NULL").orderBy("__place", F.col(by).desc_nulls_last(), "id").limit(1).drop("__place")


def entity_report(entities: DataFrame, asked: str, edges: DataFrame, entity_chunks: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """(part, ref, detail) of the entity that is asked for: itself, its active relations with direction (a loop counts as
    outbound), and its most significant newest chunks."""
    one = F.broadcast(resolved_entity(entities, asked).select(F.col("id").alias("entity_id"), "name", "entity_type"))  # one row
    head = one.select(F.lit("entity").alias("part"), F.col("entity_id").alias("ref"), F.concat_ws(" ", "name", "entity_type").alias("detail"))
    live = active(edges)
    out = live.join(one.select("entity_id"), F.col("source_id") == F.col("entity_id")).select("edge_id", F.lit("outbound").alias("way"), "relation_type", F.col("target_id").alias("other"))
    inward = live.filter("source_id <> target_id").join(one.select("entity_id"), F.col("target_id") == F.col("entity_id")).select("edge_id", F.lit("inbound").alias("way"), "relation_type", F.col("source_id").alias("other"))
    relations = out.unionByName(inward).select(F.lit("relation").alias("part"), F.col("edge_id").alias("ref"), F.concat_ws(" ", "way", "relation_type", F.col("other").cast("string")).alias("detail"))
    own = entity_chunks.join(one.select("entity_id"), "entity_id").select(F.col("chunk_id").alias("id")).join(chunks.select("id", "significance", "created_at", "chunk_type"), "id")
    top = own.orderBy(F.col("significance").desc_nulls_first(), F.col("created_at").desc_nulls_first(), "id").limit(most)
    return head.unionByName(relations).unionByName(top.select(F.lit("chunk").alias("part"), F.col("id").alias("ref"), F.coalesce("chunk_type", F.lit("")).alias("detail")))


def neighbourhood_report(entities: DataFrame, asked: str, edges: DataFrame, hops: int = 1, types: list[str] | None = None, by: str = "access_count") -> DataFrame:
    """(part, ref, detail) around the entity that is asked for: entities by depth, relations among them, totals."""
    root = resolved_entity(entities, asked, by).select(F.col("id").alias("entity_id"))
    near = neighbourhood(edges, root, hops, types)
    names = entities.select(F.col("id").alias("entity_id"), "name")
    inside = induced(edges if types is None else edges.filter(F.col("relation_type").isin(types)), near.select("entity_id").union(root))
    parts = [
        near.join(names, "entity_id").select(F.lit("entity").alias("part"), F.col("entity_id").alias("ref"), F.concat_ws(" ", F.col("depth").cast("string"), "name").alias("detail")),
        inside.select(F.lit("relation").alias("part"), F.col("edge_id").alias("ref"), F.col("relation_type").alias("detail")),
        near.groupBy("depth").agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.col("depth").cast("long").alias("ref"), F.col("n").cast("string").alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, text in zip(b["__key"], b["__text"], strict=True):
            found = english_terms(text or "")
            rows += [(term, key, n, len(found)) for term, n in Counter(found).items()] or [("", key, 0, 0)]
        yield pd.DataFrame(rows, columns=["term", "id", "tf", "n_terms"])


def build_postings(texts: DataFrame, folder: str, key: str = "id", text: str = "content", buckets: int = TERM_BUCKETS) -> None:
    """Write an inverted index of stems: term, id, tf, n_terms, in one folder per bucket of terms and sorted by term.

    A text without terms has one row with an empty term, so that the collection's size is the index's own. A search
    reads the buckets of its terms only, and in them the row groups that hold them.
    """
    rows = texts.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).mapInPandas(_postings, POSTING)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a frequent term spreads over the tasks of its bucket by a salt
    placed.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    rows.groupBy("id").agg(F.max("n_terms").alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("average")).write.mode("overwrite").parquet(f"{folder}/sizes")


def match_postings(spark: SparkSession, folder: str, query: str, buckets: int = TERM_BUCKETS) -> DataFrame:
    """(id, score): every text with all stems of the query and its BM25, in no order; none for a blank query."""
    terms = sorted(set(english_terms(query)))
    index = spark.read.schema(f"{POSTING}, bucket int").parquet(f"{folder}/postings")  # of no texts there is no file to tell it
    if not terms:
        return index.limit(0).select("id", F.lit(0.0).alias("score"))
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()]
    met = index.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    sizes = F.broadcast(spark.read.parquet(f"{folder}/sizes"))  # one row
    df = F.broadcast(met.groupBy("term").agg(F.count("*").alias("df")))  # one row a term of the query
    part = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n_terms") / F.col("average")))
    scored = met.join(df, "term").join(sizes, F.lit(True)).groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n"))
    return scored.filter(F.col("n") == len(terms)).drop("n")


def _ranked(matches: DataFrame, k: int) -> DataFrame:
    top = matches.orderBy(F.round("score", 9).desc(), "id").limit(k)
    return top.withColumn("keyword_rank", F.expr("row_number() OVER (ORDER BY round(score, 9) DESC, id)"))


def search_postings(spark: SparkSession, folder: str, query: str, k: int = 20, buckets: int = TERM_BUCKETS) -> DataFrame:
    """(id, score, keyword_rank): the k texts with all stems of the query that BM25 ranks highest; none for a blank query.

    A task holds room for k rows, so k stays small; match_postings is for all of them.
    """
    return _ranked(match_postings(spark, folder, query, buckets), k)


def search_messages(messages: DataFrame, conversations: DataFrame, query: str, first_day: str | None = None, last_day: str | None = None, source: str | None = None, limit: int = 10) -> DataFrame:
    """The best messages (with score) that hold all stems of the query, between two days (the last one included) and of
    one source; limit is clamped to 1..50, a blank query gives no row."""
    terms = sorted(set(english_terms(query)))
    rows = messages
    if first_day is not None:
        rows = rows.filter(F.col("spoken_at") >= F.lit(first_day).cast("timestamp"))
    if last_day is not None:
        rows = rows.filter(F.col("spoken_at") < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp"))
    talks = conversations.select("session_id", "source")
    rows = rows.join(talks if source is None else talks.filter(F.col("source") == source), "session_id")
    scored = bm25(rows.withColumn("__t", english_tokens("content")), "__t", terms).filter(all_terms(F.col("__t"), terms))
    return scored.orderBy(F.round("score", 9).desc(), "rec_id").limit(clamped(limit, 1, 50)).drop("__t", "n_terms")
