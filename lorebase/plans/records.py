"""Queries of problems 1 (nested records) and 4 (repeated delivery) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.dedupe import new_rows, surplus_rows
from lorebase.operators.shred import entities, shred
from lorebase.sources.tables import session_rows

BLOCK_PATHS = ("content[]", "content")
PART_PATHS = ("content[].content[]", "content.content[]", "content[].content", "content.content")
KEYS = ("rec_id", "session_id")


def surplus(spark: SparkSession, root: str) -> DataFrame:
    return surplus_rows(session_rows(spark, root).select("rec_id", "session_id", "msg_id"), ["session_id", "msg_id"], "rec_id")


def block_nodes(spark: SparkSession, root: str, paths: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    return shred(session_rows(spark, root), KEYS, "message", [*paths, *(f"{p}.{name}" for p in paths for name in labels)])


def p1_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of both session tables, one copy each; messages' roles come from the shredded root objects."""
    heads = entities(shred(session_rows(spark, root), KEYS, "message", ["", "role"]), KEYS, [""], ["role"]).select("rec_id", "role")
    rows = session_rows(spark, root).select("rec_id", "session_id", "msg_id", "parent_id", "type", F.coalesce("isSidechain", F.lit(False)).alias("sidechain"))
    return rows.join(surplus(spark, root), "rec_id", "left_anti").join(heads, "rec_id", "left")


def p1_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Content blocks: record, node, parent node, ordinal, type and the scalar fields of every kind of block."""
    labels = ("type", "text", "id", "name", "tool_use_id", "is_error")
    return entities(block_nodes(spark, root, BLOCK_PATHS, labels), KEYS, BLOCK_PATHS, labels).join(surplus(spark, root), "rec_id", "left_anti")


def p1_results(spark: SparkSession, root: str) -> DataFrame:
    """Tool results with the record and node of every call they answer (NULL where the call is missing)."""
    labels = ("type", "id", "tool_use_id", "is_error", "content")
    blocks = entities(block_nodes(spark, root, BLOCK_PATHS, labels), KEYS, BLOCK_PATHS, labels, raw=["content"]).join(surplus(spark, root), "rec_id", "left_anti")
    calls = blocks.filter((F.col("type") == "tool_use") & F.col("id").isNotNull()).select("session_id", F.col("id").alias("tool_use_id"), F.col("rec_id").alias("call_rec"), F.col("node").alias("call_node"))
    results = blocks.filter(F.col("type") == "tool_result").select(*KEYS, "node", "parent", "ordinal", "tool_use_id", "is_error", F.col("kind_content").alias("content_kind"), F.col("content").alias("content_text"))
    return results.join(calls, ["session_id", "tool_use_id"], "left")


def p1_parts(spark: SparkSession, root: str) -> DataFrame:
    """Blocks inside tool results (their content may again be an array or an object), with their parent node."""
    labels = ("type", "text")
    return entities(block_nodes(spark, root, PART_PATHS, labels), KEYS, PART_PATHS, labels).join(surplus(spark, root), "rec_id", "left_anti")


def p1_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The whole adjacency table of both session tables' messages."""
    return shred(session_rows(spark, root), ["rec_id"], "message").drop("path")


def p1_block_fields(spark: SparkSession, root: str) -> DataFrame:
    """p1_blocks without the node numbers, which SQL has no way to give."""
    return p1_blocks(spark, root).select(*KEYS, "ordinal", "type", "text", "id", "name", "tool_use_id", "is_error")


def p1_result_calls(spark: SparkSession, root: str) -> DataFrame:
    """p1_results without the node numbers and contents; call_rec is 0 where the call is missing."""
    return p1_results(spark, root).select(*KEYS, "ordinal", "tool_use_id", "is_error", "content_kind", F.coalesce("call_rec", F.lit(0)).alias("call_rec"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    labels = ("type", "id", "tool_use_id")
    blocks = entities(block_nodes(spark, root, BLOCK_PATHS, labels), KEYS, BLOCK_PATHS, labels)
    calls = F.when((F.col("type") == "tool_use"), F.col("id"))
    tool = F.coalesce(calls, F.when(F.col("type") == "tool_result", F.col("tool_use_id")))
    ends = blocks.select("rec_id", "session_id", tool.alias("tool"), calls.isNotNull().alias("call")).filter(F.col("tool").isNotNull() & F.col("session_id").isNotNull())
    ends = ends.distinct().join(surplus(spark, root), "rec_id", "left_anti")
    a, b = ends.filter("call").alias("a"), ends.filter("NOT call").alias("b")
    pairs = a.join(b, (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.tool") == F.col("b.tool")) & (F.col("a.rec_id") != F.col("b.rec_id")))
    return pairs.select(F.least("a.rec_id", "b.rec_id").alias("rec_a"), F.greatest("a.rec_id", "b.rec_id").alias("rec_b"), F.col("a.tool").alias("tool_use_id")).distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return surplus(spark, root)


def p4_messages(spark: SparkSession, root: str) -> DataFrame:
    """Every record once."""
    rows = session_rows(spark, root).select("rec_id", "session_id", "msg_id", "type", "received_at")
    return rows.join(surplus(spark, root), "rec_id", "left_anti")


def p4_increment(spark: SparkSession, root: str) -> DataFrame:
    """The records of odd batches that the even batches have not brought: an anti-join with what is stored."""
    rows = session_rows(spark, root).select("rec_id", "batch_id", "session_id", "msg_id")
    stored = rows.filter("batch_id % 2 = 0 AND session_id IS NOT NULL AND msg_id IS NOT NULL")
    return new_rows(rows.filter("batch_id % 2 = 1"), stored, ["session_id", "msg_id"], ["rec_id"]).select("rec_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_blocks, p1_results, p1_parts, p1_nodes, p1_block_fields, p1_result_calls, p4_found, p4_messages, p4_increment)}

ROWS = """
rows AS (SELECT *, nullif(lower(trim(sessionId)), '') AS session_id, nullif(lower(trim(uuid)), '') AS msg_id, nullif(lower(trim(parentUuid)), '') AS parent_id
  FROM (SELECT * FROM sample_cc_session UNION ALL SELECT * FROM emotional_session)),
surplus AS (SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY session_id, msg_id ORDER BY rec_id) AS n
  FROM rows WHERE session_id IS NOT NULL AND msg_id IS NOT NULL) WHERE n > 1),
kept AS (SELECT * FROM rows ANTI JOIN surplus USING (rec_id)),
once AS (SELECT *, CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'VARCHAR' THEN (message::JSON)->>'$' ELSE message END END AS m FROM kept WHERE message IS NOT NULL),
msgs AS (SELECT *, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM once),
blocks AS (SELECT rec_id, session_id, unnest(CASE json_type(j, '$.content') WHEN 'ARRAY' THEN CAST(j->'$.content' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.content'] END) AS b FROM msgs)
"""

FIELDS = """listed AS (SELECT rec_id, session_id, CASE json_type(j, '$.content') WHEN 'ARRAY' THEN CAST(j->'$.content' AS JSON[]) WHEN 'OBJECT' THEN [j->'$.content'] END AS a, CASE json_type(j, '$.content') WHEN 'OBJECT' THEN list_position(json_keys(j), 'content') - 1 ELSE 0 END AS base FROM msgs WHERE json_type(j) = 'OBJECT'),
each AS (SELECT rec_id, session_id, unnest(a) AS b, base + generate_subscripts(a, 1) - 1 AS ordinal FROM listed WHERE a IS NOT NULL),
fields AS (SELECT rec_id, session_id, ordinal, b, b->>'$.type' AS type, b->>'$.text' AS text, b->>'$.id' AS id, b->>'$.name' AS name, b->>'$.tool_use_id' AS tool_use_id, b->>'$.is_error' AS is_error FROM each WHERE json_type(b) = 'OBJECT')"""

SQL = {
    "p1_block_fields": f"WITH {ROWS}, {FIELDS} SELECT rec_id, session_id, ordinal, type, text, id, name, tool_use_id, is_error FROM fields",
    "p1_result_calls": f"""WITH {ROWS}, {FIELDS}, calls AS (SELECT session_id, id AS tool_use_id, rec_id AS call_rec FROM fields WHERE type = 'tool_use' AND id IS NOT NULL)
SELECT f.rec_id, f.session_id, ordinal, f.tool_use_id, is_error, CASE json_type(b, '$.content') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE lower(json_type(b, '$.content')) END AS content_kind, coalesce(call_rec, 0) AS call_rec
FROM fields f LEFT JOIN calls c ON c.session_id = f.session_id AND c.tool_use_id = f.tool_use_id WHERE type = 'tool_result'""",
    "p1_found": f"""WITH {ROWS},
calls AS (SELECT rec_id, session_id, b->>'$.id' AS tool FROM blocks WHERE b->>'$.type' = 'tool_use'),
results AS (SELECT rec_id, session_id, b->>'$.tool_use_id' AS tool FROM blocks WHERE b->>'$.type' = 'tool_result')
SELECT DISTINCT least(c.rec_id, r.rec_id) AS rec_a, greatest(c.rec_id, r.rec_id) AS rec_b, tool AS tool_use_id
FROM calls c JOIN results r USING (session_id, tool) WHERE c.rec_id <> r.rec_id""",
    "p1_records": f"""WITH {ROWS} SELECT k.rec_id, session_id, msg_id, parent_id, type, coalesce(isSidechain, FALSE) AS sidechain, x.role
FROM kept k LEFT JOIN (SELECT rec_id, j->>'$.role' AS role FROM msgs) x USING (rec_id)""",
    "p4_found": f"WITH {ROWS} SELECT rec_id FROM surplus",
    "p4_messages": f"WITH {ROWS} SELECT rec_id, session_id, msg_id, type, received_at FROM kept",
    "p4_increment": """WITH rows AS (SELECT rec_id, batch_id, nullif(lower(trim(sessionId)), '') AS s, nullif(lower(trim(uuid)), '') AS u
  FROM (SELECT * FROM sample_cc_session UNION ALL SELECT * FROM emotional_session)),
stored AS (SELECT DISTINCT s, u FROM rows WHERE batch_id % 2 = 0 AND s IS NOT NULL AND u IS NOT NULL),
batch AS (SELECT *, CASE WHEN s IS NULL OR u IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY s, u ORDER BY rec_id) END AS n FROM rows WHERE batch_id % 2 = 1)
SELECT rec_id FROM batch b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored x WHERE x.s = b.s AND x.u = b.u)""",
}
