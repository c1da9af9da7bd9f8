"""Queries of chunking, curation and ingestion, with their SQL.

Patches, merges, denials and stored rows are inputs the tables do not have; they are made from the ids (``id % n``). The
operators run on whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import vocabulary as V
from lorebase.functions.vectors import norm
from lorebase.operators import chunking as K
from lorebase.operators import curation as C
from lorebase.operators.dedupe import first_copies
from lorebase.operators.embedding import embedded, hashing_provider, model_version, with_neighbours
from lorebase.operators.ordinals import dense_ordinals
from lorebase.plans.retrieval import MESSAGES
from lorebase.sources.records import linearised, messages, unseen, violations
from lorebase.sources.tables import session_rows, table


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return messages(session_rows(spark, root))


def turn_groups(spark: SparkSession, root: str) -> DataFrame:
    return K.turn_groups(_messages(spark, root)).select("session_id", "ordinal", "turn_group")


def gap_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user more than six hours apart begin a new segment."""
    rows = dense_ordinals(table(spark, root, "events").filter("ts IS NOT NULL").withColumn("__o", F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000 + F.col("event_id") % 1_000_000), ["user_id"], "__o", "ordinal", 30 * 86_400_000 * 1_000_000)
    return K.gap_segments(rows, "user_id", "ordinal", "ts", 360).select("user_id", "event_id", "segment")


def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", K.tokens("text").cast("long").alias("tokens"))


def chunk_classify(spark: SparkSession, root: str) -> DataFrame:
    """Type and significance of the stored chunks' texts by the rules."""
    rows = table(spark, root, "chunks").select("id", F.coalesce("raw_content", F.lit("")).alias("t"))
    turns = F.split("t", "\n\n")
    human = F.array_join(F.transform(F.filter(turns, lambda x: x.startswith("Human: ")), lambda x: F.substring(x, 8, 1_000_000_000)), " ")
    kind = K.chunk_type(F.col("t"), human)
    greeting = F.col("t").startswith("Human: ") & F.substring("t", 8, 20).rlike(K.GREETING)
    return rows.select("id", kind.alias("chunk_type"), K.significance(kind, greeting).cast("long").alias("significance"))


def linearise_session(spark: SparkSession, root: str) -> DataFrame:
    """Messages in the order of their reply tree."""
    return linearised(session_rows(spark, root)).select("session_id", "rec_id", "ordinal", "role")


def chunk_conversation(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the messages as linearise_session numbers them."""
    out = K.chunked(linearised(session_rows(spark, root)))
    return out.select("session_id", "head", "part", "start_ordinal", "end_ordinal", "chunk_type", F.col("significance").cast("long"), F.length("content").cast("long").alias("n_chars"))


def chunk_text(spark: SparkSession, root: str) -> DataFrame:
    """Text of each turn as a chunk shows it: one row a turn is what is asked, so a turn's text is as long as the turn."""
    rows = K.turn_groups(_messages(spark, root)).withColumn("line", K.spoken(F.col("role"), F.col("content")))
    out = rows.groupBy("session_id", "turn_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n\n").alias("t"))
    return out.select("session_id", "turn_group", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("md5"))


def topic_boundaries(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").select("id", "conversation_id", "embedding").filter(F.size("embedding") == 64)
    return K.topic_pairs(rows, "conversation_id", "id").select("id", F.round("similarity", 6).alias("similarity"), "is_boundary")


def boundary_stats(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "chunks").select("id", "conversation_id", "embedding").filter(F.size("embedding") == 64)
    out = K.topic_pairs(rows, "conversation_id", "id").groupBy("conversation_id")
    return out.agg(F.count("*").alias("pairs"), F.count_if("is_boundary").alias("boundaries"), F.round(F.avg("similarity"), 3).alias("avg_similarity"))


def resolved_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose text changes when first and second person get names."""
    out = K.resolved_pronouns(table(spark, root, "chunks").select("id", "raw_content"))
    return out.filter(F.col("resolved") != F.col("raw_content")).select("id", F.md5("resolved").alias("md5"))


def chunk_context(spark: SparkSession, root: str) -> DataFrame:
    """The chunks before and after each chunk in its conversation."""
    rows = table(spark, root, "chunks").select("id", "conversation_id", "chunk_type")
    return with_neighbours(rows, "conversation_id", "id", ["id", "chunk_type"]).select("id", "prev_id", "next_id", "prev_chunk_type", "next_chunk_type")


def embedded_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of the chunks' texts by the offline provider: their width and length."""
    out = embedded(table(spark, root, "chunks"), "id", "raw_content", hashing_provider())
    return out.select("id", F.size("embedding").cast("long").alias("width"), F.round(norm("embedding"), 3).alias("length"))


def extraction_version(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("id", model_version("model", F.coalesce("content", F.lit("")), "entities, relations").alias("version"))


def _proposals(spark: SparkSession, root: str) -> DataFrame:
    """Names with changed case, aliases, and stretched names of the entities, as if an extractor had proposed them."""
    e = table(spark, root, "entities").filter("id > 2")
    common = lambda kind, name, match, conf: e.select((F.col("id") * 10 + kind).alias("proposal_id"), name.alias("name"), "entity_type", F.lit(match).alias("match"), conf.alias("confidence"))
    conf = (F.col("id") % 10) / 10
    parts = [common(0, F.upper("name"), "existing", conf), common(1, F.get("aliases", F.lit(0)), "uncertain", conf), common(2, F.concat("name", F.lit("s")), "new", conf), common(3, F.concat(F.lit("zq"), F.col("id").cast("string")), "new", F.lit(0.8) + (F.col("id") % 3) / 10)]
    return reduce(DataFrame.unionByName, parts).filter("name IS NOT NULL")


def _denied(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entities").filter("id % 50 = 3").select("name", "entity_type")


def route_entities(spark: SparkSession, root: str) -> DataFrame:
    return C.route_entities(_proposals(spark, root), table(spark, root, "entities"), _denied(spark, root)).select("proposal_id", "action", "entity_id", "reason")


def validate_records(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "entities").select("id", "name", "entity_type", F.when(F.col("id") % 3 == 0, "maybe").otherwise("new").alias("match"), ((F.col("id") % 13) / 10).alias("confidence"))
    return rows.select("id", F.array_join(C.entity_errors(), "; ").alias("errors"))


def upsert_entities(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "entities").select("id", "name", "entity_type", "summary")
    patch = e.filter("id % 4 = 0").select(F.when(F.col("id") % 8 == 0, F.col("name")).otherwise(F.concat(F.lit("New "), "name")).alias("name"), "entity_type", F.when(F.col("id") % 16 != 0, F.lit("patched")).alias("summary"))
    return C.upserted(e, patch).select("name", "entity_type", "summary", "action")


def denylist_backfill(spark: SparkSession, root: str) -> DataFrame:
    return C.added_denials(_denied(spark, root), table(spark, root, "entities").filter("access_count < 2"))


def resolve_names(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "entities").filter("name IS NOT NULL").select(F.upper("name").alias("name")).distinct()
    return C.resolve_name(table(spark, root, "entities"), names).select("name", "entity_id", "n")


def entity_summaries(spark: SparkSession, root: str) -> DataFrame:
    return C.summaries(table(spark, root, "entities"), table(spark, root, "entity_chunks"), table(spark, root, "chunks"))


def import_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """First document of each text that is not among the documents with ids divisible by ten, by a digest of the text."""
    docs = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    stored = docs.filter("doc_id % 10 = 0").select("digest").distinct()
    return first_copies(docs, ["digest"], ["doc_id"]).join(stored, "digest", "left_anti").select("doc_id")


def import_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that have no row in conversations."""
    batch = session_rows(spark, root).select("session_id").filter("session_id IS NOT NULL").distinct()
    return unseen(batch, table(spark, root, "conversations").filter("id % 7 <> 0").select("session_id")).select("session_id")


def constraint_violations(spark: SparkSession, root: str) -> DataFrame:
    read = lambda name: table(spark, root, name)
    talks = read("conversations").select("id")
    parts = [
        violations(read("chunks"), "chunks", unique=[["id"]], required=["content", "chunk_type", "significance"], allowed={"chunk_type": ["topic", "moment", "decision", "correction", "emotional"], "significance": [1, 2, 3, 4, 5]}, foreign={"conversation_id": (talks, "id")}),
        violations(read("entities"), "entities", unique=[["id"], ["name", "entity_type"]], allowed={"entity_type": V.ENTITY_TYPES}),
        violations(read("entity_chunks"), "entity_chunks", unique=[["entity_id", "chunk_id"]], foreign={"entity_id": (read("entities"), "id"), "chunk_id": (read("chunks"), "id")}),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        turn_groups, gap_boundaries, token_estimate, chunk_classify, linearise_session, chunk_conversation, chunk_text, topic_boundaries, boundary_stats, resolved_chunks, route_entities, validate_records, upsert_entities,
        denylist_backfill, resolve_names, entity_summaries, chunk_context, embedded_chunks, extraction_version, import_dedupe, import_conversations, constraint_violations,
    )
}

_HUMAN = r"array_to_string(list_transform(list_filter(string_split(t, chr(10) || chr(10)), lambda x: starts_with(x, 'Human: ')), lambda x: x[8:]), ' ')"
_FEEL = "len(regexp_extract_all(t, '(?i)\\b(feeling|felt|scared|anxious|happy|sad|overwhelmed|frustrated|exhausted|love|hate|angry|hurt|rough|struggling|excited|proud|spiralling|shutdown|meltdown|burnout|dysregulated)\\b'))"
_PAIRS = """WITH p AS (SELECT id, conversation_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY conversation_id ORDER BY id) AS q FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64),
s AS (SELECT id, conversation_id, CASE WHEN list_dot_product(e, e) = 0 OR list_dot_product(q, q) = 0 THEN 0.0 ELSE list_cosine_similarity(e, q) END AS similarity FROM p WHERE q IS NOT NULL)"""
_GRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({n}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2]))))"

_SUMMARY = r"""l AS (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, chunk_id DESC) AS r FROM entity_chunks JOIN chunks ON chunks.id = chunk_id QUALIFY r <= 10),
t AS (SELECT l.entity_id, r, raw_content, e.name, e.summary FROM l JOIN chunks k ON k.id = chunk_id JOIN entities e ON e.id = entity_id),
u AS (SELECT entity_id, name, r, unnest(string_split(replace(raw_content, chr(10), ' '), '. ')) AS s, generate_subscripts(string_split(replace(raw_content, chr(10), ' '), '. '), 1) AS p FROM t WHERE raw_content IS NOT NULL),
v AS (SELECT entity_id, name, r, p, rtrim(regexp_replace(trim(s, ' '), '\.+$', ''), ' ') AS s FROM u),
w AS (SELECT * FROM v WHERE s <> '' AND contains(lower(s), lower(name)) QUALIFY row_number() OVER (PARTITION BY entity_id, lower(s) ORDER BY r, p, s) = 1),
x AS (SELECT entity_id, string_agg(s, '. ' ORDER BY r, p) || '.' AS made FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY r, p, s) <= 5) GROUP BY 1),
summed AS (SELECT t.entity_id, coalesce(made, CASE WHEN summary <> '' THEN summary ELSE raw_content[1:200] END) AS made, summary FROM t LEFT JOIN x ON x.entity_id = t.entity_id WHERE r = 1)"""


def _broken(table: str, rule: str, count: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, {count} AS n"


def _without(table: str, column: str, other: str) -> str:
    return _broken(table, f"{column} has no match", f"(SELECT count(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {other}))")


def _repeated(table: str, *keys: str) -> str:
    return _broken(table, f"{', '.join(keys)} repeated", f"(SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1))")


def _where(table: str, rule: str, where: str) -> str:
    return _broken(table, rule, f"(SELECT count(*) FROM {table} WHERE {where})")


# the reply forest as paths from the root: places are the order of the paths
_WALK = f"""{MESSAGES}, talk AS (SELECT rec_id, nullif(lower(trim(sessionId)), '') AS s, nullif(lower(trim(uuid)), '') AS u, nullif(lower(trim(parentUuid)), '') AS p, coalesce(isSidechain, FALSE) AS side, type, timestamp,
  CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'VARCHAR' THEN (message::JSON)->>'$' ELSE message END END AS m FROM (SELECT * FROM sample_cc_session UNION ALL SELECT * FROM emotional_session) WHERE type IN ('user', 'assistant')),
read AS (SELECT *, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM talk WHERE s IS NOT NULL),
kept AS (SELECT rec_id, s, u, p, side, coalesce(u, chr(1) || rec_id) AS own, coalesce(epoch_us(try_cast(nullif(timestamp, '') AS TIMESTAMPTZ)), -4611686018427387904) AS at FROM read
  WHERE NOT (type = 'user' AND CASE WHEN json_type(j, '$.content') = 'ARRAY' THEN len(list_filter(CAST(j->'$.content' AS JSON[]), lambda b: b->>'$.type' = 'tool_result')) > 0 ELSE FALSE END) QUALIFY row_number() OVER (PARTITION BY s, own ORDER BY rec_id) = 1),
lnk AS (SELECT a.*, b.rec_id AS up FROM kept a LEFT JOIN kept b ON a.s = b.s AND a.u IS NOT NULL AND a.p = b.u),
reach AS (SELECT rec_id, up FROM lnk WHERE up IS NOT NULL UNION SELECT r.rec_id, l.up FROM reach r JOIN lnk l ON r.up = l.rec_id WHERE l.up IS NOT NULL),
loops AS (SELECT rec_id FROM reach GROUP BY rec_id HAVING bool_or(rec_id = up) AND rec_id = min(up)),
tree AS (SELECT *, up IS NULL OR rec_id IN (SELECT rec_id FROM loops) AS starts FROM lnk WHERE NOT side),
walk AS (SELECT rec_id, s, own, [{{'at': 0::BIGINT, 'id': rec_id}}] AS path FROM tree WHERE starts UNION ALL SELECT c.rec_id, c.s, c.own, list_append(w.path, {{'at': c.at, 'id': c.rec_id}}) FROM walk w JOIN tree c ON c.up = w.rec_id AND NOT c.starts)"""

SQL = {
    "linearise_session": f"WITH RECURSIVE {_WALK} SELECT session_id, m.rec_id, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS ordinal, role FROM msgs m JOIN walk w ON w.s = session_id AND w.own = m.own",
    "entity_summaries": f"WITH {_SUMMARY} SELECT entity_id, made AS summary FROM summed",
    "constraint_violations": " UNION ALL ".join([
        *(_where("chunks", f"{c} is null", f"{c} IS NULL") for c in ("content", "chunk_type", "significance")),
        _where("chunks", "chunk_type is not allowed", "chunk_type NOT IN ('topic', 'moment', 'decision', 'correction', 'emotional')"), _where("chunks", "significance is not allowed", "significance NOT IN (1, 2, 3, 4, 5)"),
        _repeated("chunks", "id"), _without("chunks", "conversation_id", "conversations"), _where("entities", "entity_type is not allowed", f"entity_type NOT IN {V.ENTITY_TYPES}"), _repeated("entities", "id"), _repeated("entities", "name", "entity_type"),
        _repeated("entity_chunks", "entity_id", "chunk_id"), _without("entity_chunks", "entity_id", "entities"), _without("entity_chunks", "chunk_id", "chunks"),
    ]),
    "turn_groups": f"WITH {MESSAGES} SELECT session_id, ordinal, sum(CASE WHEN role = 'human' AND ordinal > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal)::BIGINT AS turn_group FROM msgs",
    "gap_boundaries": "SELECT user_id, event_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS g FROM events WHERE ts IS NOT NULL)",
    "token_estimate": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "chunk_classify": f"""WITH c AS (SELECT id, coalesce(raw_content, '') AS t FROM chunks), k AS (SELECT id, t, CASE WHEN regexp_matches({_HUMAN}, '(?i)\\b(no not that|don''t do|instead|not that|wrong|actually no)\\b') THEN 'correction'
WHEN regexp_matches(t, '(?i)\\b(decided|going with|chose|choosing|settled on|went with)\\b') THEN 'decision' WHEN {_FEEL} >= 3 AND length(t) < 800 THEN 'moment' WHEN {_FEEL} >= 2 THEN 'emotional' ELSE 'topic' END AS chunk_type FROM c)
SELECT id, chunk_type, 3 + CASE chunk_type WHEN 'topic' THEN 0 ELSE 1 END - CASE WHEN starts_with(t, 'Human: ') AND regexp_matches(t[8:27], '(?i)^(hey|hi|hello|morning|afternoon|evening|g''day)\\b') THEN 1 ELSE 0 END::BIGINT AS significance FROM k""",
    "chunk_text": f"""WITH {MESSAGES}, g AS (SELECT *, sum(CASE WHEN role = 'human' AND ordinal > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal)::BIGINT AS turn_group FROM msgs),
t AS (SELECT session_id, turn_group, string_agg(CASE role WHEN 'human' THEN 'Human: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY ordinal) AS t FROM g GROUP BY ALL) SELECT session_id, turn_group, length(t) AS n_chars, md5(t) AS md5 FROM t""",
    "topic_boundaries": _PAIRS + " SELECT id, round(similarity, 6) AS similarity, similarity < 0.5 AS is_boundary FROM s",
    "boundary_stats": _PAIRS + " SELECT conversation_id, count(*) AS pairs, count(*) FILTER (similarity < 0.5) AS boundaries, round(avg(similarity), 3) AS avg_similarity FROM s GROUP BY 1",
    "route_entities": f"""WITH e AS (SELECT * FROM entities WHERE id > 2), p AS (SELECT id * 10 AS proposal_id, upper(name) AS name, entity_type, 'existing' AS match, (id % 10) / 10 AS c FROM e UNION ALL SELECT id * 10 + 1, aliases[1], entity_type, 'uncertain', (id % 10) / 10 FROM e
UNION ALL SELECT id * 10 + 2, name || 's', entity_type, 'new', (id % 10) / 10 FROM e UNION ALL SELECT id * 10 + 3, 'zq' || id, entity_type, 'new', 0.8 + (id % 3) / 10 FROM e),
q AS (SELECT *, lower(trim(name)) AS k FROM p WHERE name IS NOT NULL), den AS (SELECT DISTINCT lower(name) AS k, entity_type, TRUE AS denied FROM entities WHERE id % 50 = 3),
ex AS (SELECT lower(name) AS k, entity_type, min(id) AS exact_id FROM entities GROUP BY ALL), cr AS (SELECT lower(name) AS k, min(id) AS cross_id FROM entities GROUP BY ALL),
al AS (SELECT lower(a) AS k, entity_type, min(id) AS alias_id FROM (SELECT id, entity_type, unnest(aliases) AS a FROM entities) GROUP BY ALL),
g AS (SELECT id, entity_type, {_GRAMS.format(n='name')} AS t FROM entities), h AS (SELECT proposal_id, entity_type, {_GRAMS.format(n='k')} AS t FROM q),
f AS (SELECT h.proposal_id, arg_min(g.id, (-round(len(list_intersect(g.t, h.t)) / len(list_distinct(g.t || h.t)), 12), g.id)) AS fuzzy_id FROM h JOIN g USING (entity_type) WHERE len(list_intersect(g.t, h.t)) / len(list_distinct(g.t || h.t)) > 0.6 GROUP BY 1)
SELECT proposal_id, CASE WHEN k IN ('user', 'assistant') THEN 'singleton' WHEN denied THEN 'skip' WHEN exact_id IS NOT NULL AND c >= 0.7 THEN 'apply_existing' WHEN exact_id IS NOT NULL OR cross_id IS NOT NULL THEN 'review'
  WHEN alias_id IS NOT NULL AND c >= 0.7 THEN 'apply_existing' WHEN alias_id IS NOT NULL OR fuzzy_id IS NOT NULL THEN 'review' WHEN match = 'new' AND c >= 0.85 THEN 'create_new' ELSE 'review' END AS action,
CASE WHEN k = 'user' THEN 1 WHEN k = 'assistant' THEN 2 WHEN denied THEN NULL ELSE coalesce(exact_id, cross_id, alias_id, fuzzy_id) END AS entity_id,
CASE WHEN k IN ('user', 'assistant') THEN 'speaker' WHEN denied THEN 'denied' WHEN exact_id IS NOT NULL AND c >= 0.7 THEN 'exact' WHEN exact_id IS NOT NULL THEN 'exact, low confidence' WHEN cross_id IS NOT NULL THEN 'other type'
  WHEN alias_id IS NOT NULL AND c >= 0.7 THEN 'alias' WHEN alias_id IS NOT NULL THEN 'alias, low confidence' WHEN fuzzy_id IS NOT NULL THEN 'similar' WHEN match = 'new' AND c >= 0.85 THEN 'new' ELSE 'below threshold' END AS reason
FROM q LEFT JOIN den USING (k, entity_type) LEFT JOIN ex USING (k, entity_type) LEFT JOIN cr USING (k) LEFT JOIN al USING (k, entity_type) LEFT JOIN f USING (proposal_id)""",
    "validate_records": f"""SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(name, '')) = '' THEN 'name is missing' END, CASE WHEN entity_type IS NULL OR entity_type NOT IN {V.ENTITY_TYPES} THEN 'entity_type is unknown' END,
CASE WHEN id % 3 = 0 THEN 'match is unknown' END, CASE WHEN (id % 13) / 10 > 1 THEN 'confidence is not between 0 and 1' END], lambda x: x IS NOT NULL), '; ') AS errors FROM entities""",
    "upsert_entities": """WITH p AS (SELECT CASE WHEN id % 8 = 0 THEN name ELSE 'New ' || name END AS name, entity_type, CASE WHEN id % 16 <> 0 THEN 'patched' END AS s FROM entities WHERE id % 4 = 0), q AS (SELECT name, entity_type, max(s) AS s, TRUE AS hit FROM p GROUP BY ALL)
SELECT name, entity_type, coalesce(s, summary) AS summary, CASE WHEN id IS NULL THEN 'created' WHEN hit THEN 'updated' ELSE 'kept' END AS action FROM (SELECT id, name, entity_type, summary FROM entities) FULL JOIN q USING (name, entity_type)""",
    "denylist_backfill": "SELECT DISTINCT lower(trim(name)) AS name, entity_type FROM entities WHERE access_count < 2 AND trim(name) <> '' AND (lower(trim(name)), entity_type) NOT IN (SELECT (lower(name), entity_type) FROM entities WHERE id % 50 = 3)",
    "resolve_names": "WITH n AS (SELECT DISTINCT upper(name) AS name FROM entities WHERE name IS NOT NULL), k AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS e FROM entities GROUP BY 1) SELECT name, CASE WHEN coalesce(n, 0) = 1 THEN e END AS entity_id, coalesce(n, 0) AS n FROM n LEFT JOIN k ON k = lower(trim(name))",
    "chunk_context": "SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lag(chunk_type) OVER w AS prev_chunk_type, lead(chunk_type) OVER w AS next_chunk_type FROM chunks WINDOW w AS (PARTITION BY conversation_id ORDER BY id)",
    "embedded_chunks": "SELECT id, CASE WHEN regexp_matches(coalesce(raw_content, ''), '\\S') THEN 64::BIGINT END AS width, CASE WHEN regexp_matches(coalesce(raw_content, ''), '\\S') THEN 1.0::DOUBLE END AS length FROM chunks",
    "extraction_version": "SELECT id, 'model-' || sha256(coalesce(content, '') || chr(10) || 'entities, relations')[1:12] AS version FROM chunks",
    "import_dedupe": "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT min(doc_id) AS doc_id FROM d WHERE text NOT IN (SELECT text FROM d WHERE doc_id % 10 = 0) GROUP BY text",
    "import_conversations": "SELECT DISTINCT s AS session_id FROM (SELECT nullif(lower(trim(sessionId)), '') AS s FROM (SELECT sessionId FROM sample_cc_session UNION ALL SELECT sessionId FROM emotional_session)) WHERE s IS NOT NULL AND s NOT IN (SELECT lower(trim(session_id)) FROM conversations WHERE id % 7 <> 0 AND session_id IS NOT NULL)",
}
