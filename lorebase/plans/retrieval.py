"""Queries of retrieval, search and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions.text import all_terms, simple_tokens
from lorebase.operators import retrieval as R
from lorebase.operators.ordinals import context_rows
from lorebase.session import cut
from lorebase.sources.records import conversation_names, messages
from lorebase.sources.tables import session_rows, table

AS_OF = "2026-06-01 00:00:00"
TERMS = ["index", "notes"]
#: query vector of the single-vector queries; a fixed wave of the tables' width
QUERY = [round(((i * 37) % 64 - 31.5) / 100, 3) for i in range(64)]
BATCH = {q: [round(((i * (2 * q + 3)) % 64 - 31.5) / 100, 3) for i in range(64)] for q in range(10)}


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks")


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return messages(session_rows(spark, root))


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    return R.vector_arm(_chunks(spark, root), QUERY).select("id", F.round("similarity", 6).alias("similarity"), F.col("vector_rank").cast("long"))


def vector_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    return R.vector_arm(_chunks(spark, root).filter("chunk_type = 'decision'"), QUERY).select("id", F.round("similarity", 6).alias("similarity"))


def keyword_match(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunks(spark, root).select("id", simple_tokens("content").alias("t"))
    return rows.filter(all_terms(F.col("t"), TERMS)).select("id", F.size("t").cast("long").alias("n_terms"))


def keyword_rank_bm25(spark: SparkSession, root: str) -> DataFrame:
    return R.keyword_arm(_chunks(spark, root), TERMS).select("id", F.round("score", 6).alias("score"), F.col("keyword_rank").cast("long"))


def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    c = _chunks(spark, root)
    fused = R.fuse(R.vector_arm(c, QUERY), R.keyword_arm(c, TERMS))
    return fused.select("id", *(F.round(x, 6).alias(x) for x in ("rrf_vector", "rrf_keyword", "hybrid_score")))


def hybrid_recall(spark: SparkSession, root: str) -> DataFrame:
    out = R.recall(_chunks(spark, root), QUERY, TERMS, AS_OF)
    return out.select("id", *(F.round(x, 6).alias(x) for x in ("rrf_vector", "rrf_keyword", "final_score")))


def recency_significance_score(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).select("id", F.round(R.recency(F.col("created_at"), AS_OF), 6).alias("recency_score"), R.significance(F.col("significance")).alias("significance_score"))


def batch_recall(spark: SparkSession, root: str) -> DataFrame:
    return R.batch_top(_chunks(spark, root), BATCH, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def recall_entities(spark: SparkSession, root: str) -> DataFrame:
    hits = R.recall(_chunks(spark, root), QUERY, TERMS, AS_OF)
    return R.expand_entities(hits, table(spark, root, "entity_chunks"), table(spark, root, "entities"))


def access_tracking(spark: SparkSession, root: str) -> DataFrame:
    hits = R.recall(_chunks(spark, root), QUERY, TERMS, AS_OF)
    log = R.access_log(hits, table(spark, root, "entity_chunks"), AS_OF)
    return R.access_counts(table(spark, root, "entities").select("id", "access_count", "last_accessed_at"), log, "entity").select("id", F.col("access_count").cast("long"))


def message_ordinals(spark: SparkSession, root: str) -> DataFrame:
    return _messages(spark, root).select("session_id", "rec_id", "ordinal", "role", F.length("content").cast("long").alias("n_chars"))


def message_search_context(spark: SparkSession, root: str) -> DataFrame:
    """Messages with all terms, and the messages at most two places from them."""
    said = cut(_messages(spark, root).select("session_id", "ordinal", "rec_id", "role", "content"))  # read off the JSON once
    hits = said.filter(all_terms(simple_tokens("content"), ["importer", "notes"]))
    return context_rows(said, hits, "session_id", "ordinal").select("session_id", "hit_ordinal", "ordinal", "rec_id", "role")


def message_search_dated(spark: SparkSession, root: str) -> DataFrame:
    """Search within a range of days (the last one included) and one source."""
    said = _messages(spark, root).filter("spoken_at >= '2026-01-01' AND spoken_at < date_add(DATE'2026-03-31', 1)")
    talks = table(spark, root, "conversations").filter("source = 'cc'").select("session_id", "source")
    return said.filter(all_terms(simple_tokens("content"), ["importer"])).join(talks, "session_id").select("session_id", "rec_id", "source")


def chunk_messages_range(spark: SparkSession, root: str) -> DataFrame:
    spans = table(spark, root, "chunks").select(F.col("id").alias("chunk_id"), "conversation_id", F.col("start_ordinal").cast("long"), F.col("end_ordinal").cast("long")).filter("start_ordinal <= end_ordinal")
    talks = table(spark, root, "conversations").select(F.col("id").alias("conversation_id"), "session_id")
    return R.expand_messages(spans.join(talks, "conversation_id"), _messages(spark, root)).select("chunk_id", "ordinal", "rec_id")


def conversation_transcript(spark: SparkSession, root: str) -> DataFrame:
    talks = table(spark, root, "conversations").filter("id = 1").select("session_id")
    return _messages(spark, root).join(talks, "session_id").select("session_id", "ordinal", "role", F.length("content").cast("long").alias("n_chars"))


def conversation_titles(spark: SparkSession, root: str) -> DataFrame:
    return conversation_names(_messages(spark, root))


def recent_conversations(spark: SparkSession, root: str) -> DataFrame:
    """The ten newest conversations since midnight, Melbourne time, seven days before."""
    local = F.date_trunc("day", F.from_utc_timestamp(F.lit("2026-04-05 03:00:00").cast("timestamp"), "Australia/Melbourne")) - F.expr("INTERVAL 7 DAYS")
    rows = table(spark, root, "conversations").filter(F.col("started_at") >= F.to_utc_timestamp(local, "Australia/Melbourne"))
    return rows.orderBy(F.col("started_at").desc(), "id").limit(10).select("id", "session_id", "started_at")


def entity_lookup_exact_first(spark: SparkSession, root: str) -> DataFrame:
    """Ten best matches of a name part: the exact name first, then the most used."""
    part = "flebedotol"
    rows = table(spark, root, "entities").filter(F.lower("name").contains(part)).withColumn("match_class", F.when(F.lower("name") == part, 0).otherwise(1).cast("long"))
    return rows.orderBy("match_class", F.col("access_count").desc_nulls_first(), "id").limit(10).select("id", "name", "match_class")


def entity_chunk_profile(spark: SparkSession, root: str) -> DataFrame:
    """Twenty most significant, newest chunks linked to entity 1, with their conversations."""
    linked = table(spark, root, "entity_chunks").filter("entity_id = 1").select(F.col("chunk_id").alias("id"))
    rows = table(spark, root, "chunks").select("id", "conversation_id", "significance").join(linked, "id")
    talks = table(spark, root, "conversations").select(F.col("id").alias("conversation_id"), "started_at")
    return rows.join(talks, "conversation_id").orderBy(F.col("significance").desc_nulls_first(), F.col("started_at").desc_nulls_first(), "id").limit(20).select("id", "conversation_id", F.col("significance").cast("long"), "started_at")


def boot_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Ten most used entities among those updated within seven days and used at least three times."""
    rows = table(spark, root, "entities").filter((F.col("updated_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")) & (F.col("access_count") >= 3))
    return rows.orderBy(F.col("access_count").desc(), F.col("updated_at").desc(), "id").limit(10).select("id", "name", F.col("access_count").cast("long"))


def system_stats(spark: SparkSession, root: str) -> DataFrame:
    """Tidy counts; each table is read once."""
    one = lambda name, *aggs: table(spark, root, name).agg(F.count("*").alias(name), *aggs)
    parts = [
        one("conversations", F.count_if(F.col("message_count").isNull()).alias("conversations without count")),
        one("chunks", F.count_if(F.col("embedding").isNull()).alias("chunks without vector"), F.count_if(F.col("significance") >= 4).alias("significant chunks")),
        one("entities", F.count_if(F.col("access_count") >= 3).alias("entities in use")),
        one("entity_chunks"),
    ]
    tidy = [p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in p.columns))).alias("x")).select("x.*") for p in parts]
    return tidy[0].unionByName(tidy[1]).unionByName(tidy[2]).unionByName(tidy[3])


def type_distribution(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entities").groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity_type")


def latest_per_type(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").filter("chunk_type IS NOT NULL AND created_at IS NOT NULL")
    return rows.groupBy("chunk_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def status_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Conversations by status, finished and failed ones left out; an unknown status is neither."""
    rows = table(spark, root, "conversations").filter(~F.col("pipeline_status").isin("complete", "failed", "extracted"))
    return rows.groupBy("pipeline_status").agg(F.count("*").alias("n"))


def json_predicate(spark: SparkSession, root: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    rows = table(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.filter("k IS NOT NULL").select("event_id", "k")


def latest_event_per_user(spark: SparkSession, root: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, root, "events").withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_recall, vector_topk, vector_topk_filtered, keyword_match, keyword_rank_bm25, rrf_fusion, recency_significance_score, batch_recall, recall_entities, access_tracking, message_ordinals,
        message_search_context, message_search_dated, chunk_messages_range, conversation_transcript, conversation_titles, recent_conversations, entity_lookup_exact_first, entity_chunk_profile, boot_snapshot,
        system_stats, type_distribution, latest_per_type, status_breakdown, json_predicate, latest_event_per_user,
    )
}

_V = "[" + ", ".join(map(str, QUERY)) + "]"
_SIM = f"CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], {_V}::DOUBLE[]) END"
_TOK = r"list_filter(string_split_regex(lower(coalesce(content, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _varm(where: str = "TRUE") -> str:
    return f"""varm AS (SELECT id, s AS similarity, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT id, {_SIM} AS s FROM chunks WHERE embedding IS NOT NULL AND {where}) QUALIFY vector_rank <= 20)"""


_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_IDF = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / al))" for i in range(len(TERMS)))
_KARM = f"""tok AS (SELECT id, {_TOK} AS t FROM chunks), tf AS (SELECT *, {_TF} FROM tok),
st AS (SELECT count(*) AS n, avg(len(t)) AS al, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf),
karm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS keyword_rank FROM (SELECT id, {_IDF} AS score FROM tf, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(TERMS)))}) QUALIFY keyword_rank <= 20)"""
_FUSED = f"""{_varm()}, {_KARM}, fused AS (SELECT id, vector_rank, keyword_rank, coalesce(1 / (60 + vector_rank), 0) AS rrf_vector, coalesce(1 / (60 + keyword_rank), 0) AS rrf_keyword FROM varm FULL JOIN karm USING (id))"""
_REC = f"coalesce(1 / (1 + greatest((epoch(TIMESTAMPTZ '{AS_OF}+00') - epoch(created_at)) / 86400, 0) / 180), 0.5)"
_RECALL = f"""{_FUSED}, ranked AS (SELECT id, rrf_vector, rrf_keyword, vector_rank, keyword_rank, 0.6 * (rrf_vector + rrf_keyword) / max(rrf_vector + rrf_keyword) OVER () + 0.2 * {_REC} + 0.2 * coalesce(significance, 3) / 5 AS final_score
FROM fused JOIN chunks USING (id)), hits AS (SELECT * FROM ranked ORDER BY final_score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id LIMIT 10)"""
MESSAGES = r"""raw AS (SELECT rec_id, nullif(lower(trim(sessionId)), '') AS session_id, coalesce(nullif(lower(trim(uuid)), ''), chr(1) || rec_id) AS own, type, timestamp, message, isSidechain
  FROM (SELECT * FROM sample_cc_session UNION ALL SELECT * FROM emotional_session)),
one AS (SELECT *, CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'VARCHAR' THEN (message::JSON)->>'$' ELSE message END END AS m FROM raw
  WHERE type IN ('user', 'assistant') AND NOT coalesce(isSidechain, FALSE) AND message IS NOT NULL AND session_id IS NOT NULL),
two AS (SELECT *, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM one),
three AS (SELECT *, CASE WHEN json_type(j, '$.content') = 'ARRAY' THEN CAST(j->'$.content' AS JSON[]) END AS a FROM two),
four AS (SELECT rec_id, session_id, own, CASE type WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, try_cast(nullif(timestamp, '') AS TIMESTAMPTZ) AS spoken_at,
  trim(replace(CASE json_type(j, '$.content') WHEN 'VARCHAR' THEN j->>'$.content' WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(list_filter(a, lambda b: b->>'$.type' = 'text'), lambda b: b->>'$.text'), lambda x: x IS NOT NULL), chr(10) || chr(10))
  WHEN 'OBJECT' THEN CASE WHEN j->>'$.content.type' = 'text' THEN j->>'$.content.text' END END, chr(0), ''), ' ') AS content FROM three
  WHERE NOT (type = 'user' AND coalesce(len(list_filter(a, lambda b: b->>'$.type' = 'tool_result')) > 0, FALSE))),
msgs AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rec_id) - 1 AS ordinal FROM (SELECT * FROM four WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY session_id, own ORDER BY rec_id) = 1))"""


def _has(*terms: str) -> str:
    tok = _TOK
    return " AND ".join(f"list_contains({tok}, '{t}')" for t in terms)


SQL = {
    "vector_topk": f"WITH {_varm()} SELECT id, round(similarity, 6) AS similarity, vector_rank FROM varm",
    "vector_topk_filtered": f"WITH {_varm(chr(39).join(['chunk_type = ', 'decision', '']))} SELECT id, round(similarity, 6) AS similarity FROM varm",
    "keyword_match": f"SELECT id, len({_TOK}) AS n_terms FROM chunks WHERE {_has(*TERMS)}",
    "keyword_rank_bm25": f"WITH {_KARM} SELECT id, round(score, 6) AS score, keyword_rank FROM karm",
    "rrf_fusion": f"WITH {_FUSED} SELECT id, round(rrf_vector, 6) AS rrf_vector, round(rrf_keyword, 6) AS rrf_keyword, round(rrf_vector + rrf_keyword, 6) AS hybrid_score FROM fused",
    "hybrid_recall": f"WITH {_RECALL} SELECT id, round(rrf_vector, 6) AS rrf_vector, round(rrf_keyword, 6) AS rrf_keyword, round(final_score, 6) AS final_score FROM hits",
    "recency_significance_score": f"SELECT id, round({_REC}, 6) AS recency_score, coalesce(significance, 3) / 5 AS significance_score FROM chunks",
    "batch_recall": "WITH q AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS query_id, {v}::DOUBLE[] AS e" for k, v in BATCH.items()) + """), s AS (SELECT query_id, id, list_cosine_similarity(embedding::DOUBLE[], e) AS s
FROM chunks, q WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND query_id <> id)
SELECT query_id, id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 5""",
    "recall_entities": f"WITH {_RECALL} SELECT chunk_id, entity_id, name, entity_type FROM hits JOIN entity_chunks x ON x.chunk_id = hits.id JOIN entities e ON e.id = x.entity_id",
    "access_tracking": f"WITH {_RECALL} SELECT id, coalesce(access_count, 0)::BIGINT + CASE WHEN id IN (SELECT entity_id FROM entity_chunks WHERE chunk_id IN (SELECT id FROM hits)) THEN 1 ELSE 0 END::BIGINT AS access_count FROM entities",
    "message_ordinals": f"WITH {MESSAGES} SELECT session_id, rec_id, ordinal, role, length(content) AS n_chars FROM msgs",
    "message_search_context": f"WITH {MESSAGES}, hit AS (SELECT session_id, ordinal AS hit_ordinal FROM msgs WHERE {_has('importer', 'notes')}) SELECT session_id, hit_ordinal, ordinal, rec_id, role FROM hit JOIN msgs USING (session_id) WHERE ordinal BETWEEN hit_ordinal - 2 AND hit_ordinal + 2",
    "message_search_dated": f"WITH {MESSAGES} SELECT session_id, rec_id, source FROM msgs JOIN (SELECT session_id, source FROM conversations WHERE source = 'cc') USING (session_id) WHERE spoken_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND spoken_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' AND {_has('importer')}",
    "chunk_messages_range": f"WITH {MESSAGES} SELECT k.id AS chunk_id, ordinal, rec_id FROM chunks k JOIN conversations c ON c.id = k.conversation_id JOIN msgs USING (session_id) WHERE ordinal BETWEEN start_ordinal AND least(end_ordinal, start_ordinal + 99)",
    "conversation_transcript": f"WITH {MESSAGES} SELECT session_id, ordinal, role, length(content) AS n_chars FROM msgs WHERE session_id = (SELECT session_id FROM conversations WHERE id = 1)",
    "conversation_titles": rf"""WITH {MESSAGES}, f AS (SELECT session_id, trim(replace(arg_min(content, ordinal), chr(10), ' ')) AS t FROM msgs WHERE role = 'human' GROUP BY session_id)
SELECT session_id, CASE WHEN t IS NULL THEN 'Untitled conversation' WHEN length(t) <= 80 THEN t ELSE coalesce(nullif(regexp_extract(t[1:77], '^(.*) [^ ]*$', 1), ''), t[1:77]) || '...' END AS name FROM (SELECT DISTINCT session_id FROM msgs) LEFT JOIN f USING (session_id)""",
    "recent_conversations": f"""SELECT id, session_id, started_at FROM conversations WHERE started_at >= (date_trunc('day', TIMESTAMPTZ '2026-04-05 03:00:00+00' AT TIME ZONE 'Australia/Melbourne') - INTERVAL 7 DAYS) AT TIME ZONE 'Australia/Melbourne' ORDER BY started_at DESC, id LIMIT 10""",
    "entity_lookup_exact_first": "SELECT id, name, CASE WHEN lower(name) = 'flebedotol' THEN 0 ELSE 1 END::BIGINT AS match_class FROM entities WHERE contains(lower(name), 'flebedotol') ORDER BY match_class, access_count DESC NULLS FIRST, id LIMIT 10",
    "entity_chunk_profile": "SELECT k.id, conversation_id, significance::BIGINT AS significance, started_at FROM chunks k JOIN conversations c ON c.id = conversation_id WHERE k.id IN (SELECT chunk_id FROM entity_chunks WHERE entity_id = 1) ORDER BY k.significance DESC NULLS FIRST, started_at DESC NULLS FIRST, k.id LIMIT 20",
    "boot_snapshot": f"SELECT id, name, access_count::BIGINT AS access_count FROM entities WHERE updated_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 7 DAYS AND access_count >= 3 ORDER BY access_count DESC, updated_at DESC, id LIMIT 10",
    "system_stats": """SELECT 'conversations' AS metric, count(*) AS value FROM conversations UNION ALL SELECT 'conversations without count', count(*) FROM conversations WHERE message_count IS NULL
UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'chunks without vector', count(*) FROM chunks WHERE embedding IS NULL UNION ALL SELECT 'significant chunks', count(*) FROM chunks WHERE significance >= 4
UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'entities in use', count(*) FROM entities WHERE access_count >= 3 UNION ALL SELECT 'entity_chunks', count(*) FROM entity_chunks""",
    "type_distribution": "SELECT entity_type, count(*) AS n FROM entities GROUP BY 1",
    "latest_per_type": "SELECT chunk_type, id, created_at FROM chunks WHERE chunk_type IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_type ORDER BY created_at DESC, id DESC) = 1",
    "status_breakdown": "SELECT pipeline_status, count(*) AS n FROM conversations WHERE pipeline_status NOT IN ('complete', 'failed', 'extracted') GROUP BY 1",
    "json_predicate": "SELECT event_id, props->>'$.k' AS k FROM events WHERE props->>'$.k' IS NOT NULL",
    "latest_event_per_user": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
