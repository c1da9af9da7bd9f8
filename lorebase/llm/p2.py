"""Queries of problem 2, conversations from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm.conversations import judged, rebuilt
from lorebase.sources.tables import session_rows


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return judged(session_rows(spark, root))[0].filter("session_id IS NOT NULL").select("session_id")


def p2_turns(spark: SparkSession, root: str) -> DataFrame:
    return rebuilt(session_rows(spark, root))


QUERIES = {f.__name__: f for f in (p2_found, p2_turns)}

_JUDGED = r"""WITH RECURSIVE rows AS (SELECT rec_id, nullif(lower(trim(sessionId)), '') AS s, nullif(lower(trim(uuid)), '') AS u, nullif(lower(trim(parentUuid)), '') AS p, type,
    NOT coalesce(isSidechain, FALSE) AS main, message FROM (SELECT * FROM sample_cc_session UNION ALL SELECT * FROM emotional_session)),
kept AS (SELECT * FROM rows QUALIFY u IS NULL OR row_number() OVER (PARTITION BY s, u ORDER BY rec_id) = 1),
once AS (SELECT *, CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'VARCHAR' THEN (message::JSON)->>'$' ELSE message END END AS m FROM kept),
msgs AS (SELECT *, CASE WHEN json_valid(m) THEN m::JSON END AS j FROM once),
txt AS (SELECT *, message IS NOT NULL AND j IS NULL AS unreadable, main AND type IN ('user', 'assistant') AND regexp_matches(coalesce(CASE json_type(j, '$.content')
    WHEN 'VARCHAR' THEN j->>'$.content'
    WHEN 'ARRAY' THEN list_reduce(list_prepend('', list_transform(list_filter(CAST(j->'$.content' AS JSON[]), lambda b: b->>'$.type' = 'text'), lambda b: coalesce(b->>'$.text', ''))), lambda a, b: a || b)
    WHEN 'OBJECT' THEN CASE WHEN j->>'$.content.type' = 'text' THEN j->>'$.content.text' END END, ''), '\S') AS said FROM msgs),
lnk AS (SELECT a.rec_id, a.s, a.u, b.rec_id AS up FROM txt a LEFT JOIN txt b ON a.s = b.s AND a.p = b.u),
reach AS (SELECT rec_id, up FROM lnk WHERE up IS NOT NULL UNION SELECT r.rec_id, l.up FROM reach r JOIN lnk l ON r.up = l.rec_id WHERE l.up IS NOT NULL),
broken AS (SELECT s FROM txt WHERE unreadable UNION SELECT a.s FROM txt a JOIN lnk l USING (rec_id) WHERE a.u IS NOT NULL AND a.p IS NOT NULL AND l.up IS NULL
  UNION SELECT s FROM reach JOIN txt USING (rec_id) WHERE reach.rec_id = up),
hollow AS (SELECT s FROM txt GROUP BY s HAVING NOT bool_or(said)),
answered AS (SELECT DISTINCT up AS rec_id FROM reach JOIN txt t ON t.rec_id = reach.rec_id WHERE t.said AND t.type = 'assistant'),
waiting AS (SELECT s FROM txt WHERE said AND type = 'user' AND rec_id NOT IN (SELECT rec_id FROM answered))"""

SQL = {
    "p2_found": _JUDGED + " SELECT s AS session_id FROM (SELECT s FROM broken UNION SELECT s FROM hollow UNION SELECT s FROM waiting) WHERE s IS NOT NULL",
    "p2_turns": _JUDGED + r""", dropped AS (SELECT s FROM broken UNION SELECT s FROM hollow UNION SELECT s FROM waiting),
roots AS (SELECT reach.rec_id, reach.up AS root FROM reach JOIN lnk l ON l.rec_id = reach.up WHERE l.up IS NULL), depths AS (SELECT rec_id, count(*) AS depth FROM reach GROUP BY 1),
placed AS (SELECT t.rec_id, t.s, t.type, t.j, coalesce(root, t.rec_id) AS root, coalesce(depth, 0) AS depth FROM txt t LEFT JOIN roots r ON r.rec_id = t.rec_id LEFT JOIN depths d ON d.rec_id = t.rec_id),
named AS (SELECT *, min(rec_id) OVER (PARTITION BY root) AS thread FROM placed),
spoken AS (SELECT n.*, try_cast(nullif(r.timestamp, '') AS TIMESTAMPTZ) AS spoken_at, CASE json_type(j, '$.content') WHEN 'VARCHAR' THEN j->>'$.content' WHEN 'OBJECT' THEN CASE WHEN j->>'$.content.type' = 'text' THEN j->>'$.content.text' END
  WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(list_filter(CAST(j->'$.content' AS JSON[]), lambda b: b->>'$.type' = 'text'), lambda b: b->>'$.text'), lambda x: x IS NOT NULL), chr(10)) END AS text
  FROM named n JOIN (SELECT rec_id, timestamp FROM sample_cc_session UNION ALL SELECT rec_id, timestamp FROM emotional_session) r ON r.rec_id = n.rec_id WHERE type IN ('user', 'assistant'))
SELECT s AS conversation, thread, depth, spoken_at, rec_id, type AS speaker, text FROM spoken WHERE regexp_matches(coalesce(text, ''), '\S') AND s NOT IN (SELECT s FROM dropped WHERE s IS NOT NULL)""",
}
