"""Queries of linking, review, audits, composed reads and upkeep, with their SQL.

What an extractor or a reviewer would hand over (proposals, relations, decisions, patches) is made from the ids of the
tables, which have none; the operators run on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import STOP_WORDS
from lorebase.operators import audits as A
from lorebase.operators import curation as C
from lorebase.operators import linking as L
from lorebase.operators import lookup as U
from lorebase.operators import retrieval as R
from lorebase.operators import upkeep as K
from lorebase.plans.curation import _PAIRS, _SUMMARY, _denied, _proposals
from lorebase.plans.curation import SQL as CURATION
from lorebase.plans.graph import CUSTOMER, edges, nodes
from lorebase.plans.graph import SQL as GRAPH
from lorebase.plans.retrieval import _REC, _RECALL, AS_OF, MESSAGES, QUERY, TERMS, _varm
from lorebase.session import cut, shared_folder
from lorebase.sources.records import messages
from lorebase.sources.tables import session_rows, table

CHUNKS = 97
RELATIONS = ["uses", "works_at", "knows", "bogus"]
EDGE = "edge_id long, source_id long, target_id long, relation_type string, description string, valid_from timestamp, superseded_at timestamp"


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return table(spark, root, name)


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """The user uses every twentieth entity and works at the fifth; every thirtieth knows the one before it, once."""
    e = _read(spark, root, "entities").filter("id > 2")
    never = F.lit(None).cast("timestamp")
    row = lambda edge, source, target, kind: [edge.cast("long").alias("edge_id"), source.cast("long").alias("source_id"), target.cast("long").alias("target_id"), F.lit(kind).alias("relation_type"), F.lit("told").alias("description"), never.alias("valid_from"), never.alias("superseded_at")]
    uses = e.filter("id % 20 = 0").select(*row(F.col("id"), F.lit(1), F.col("id"), "uses"))
    works = e.filter("id = 5").select(*row(F.lit(1), F.lit(1), F.col("id"), "works_at"))
    knows = e.filter("id % 30 = 0").select(*row(F.col("id") + 1, F.col("id"), F.col("id") - 1, "knows"))
    return uses.unionByName(works).unionByName(knows)


def _linked(spark: SparkSession, root: str) -> L.Linked:
    own = (1 + F.col("proposal_id") % CHUNKS).alias("chunk_id")
    proposals = _proposals(spark, root).select("*", own, F.when(F.col("proposal_id") % 5 == 0, "told").alias("summary"), F.lit("as said").alias("reasoning"))
    kind = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("proposal_id") % 4 + 1).cast("int"))
    relations = proposals.select(F.col("proposal_id").alias("relation_id"), "chunk_id", F.lit("User").alias("source"), F.col("name").alias("target"), kind.alias("relation_type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("timestamp").alias("valid_from"))
    flags = proposals.filter("proposal_id % 11 = 0").select("chunk_id")
    return L.linked(proposals, relations, _read(spark, root, "entities"), _denied(spark, root), _edges(spark, root), flags)


def extraction_actions(spark: SparkSession, root: str) -> DataFrame:
    return _linked(spark, root).actions.select("proposal_id", "chunk_id", "action", "entity_id")


def extraction_relations(spark: SparkSession, root: str) -> DataFrame:
    return _linked(spark, root).relations.select("relation_id", "chunk_id", "source_id", "target_id", "outcome")


def extraction_counters(spark: SparkSession, root: str) -> DataFrame:
    return _linked(spark, root).counters


def extraction_rollup(spark: SparkSession, root: str) -> DataFrame:
    return L.rolled_up(_linked(spark, root).counters, _read(spark, root, "chunks"))


def extraction_links(spark: SparkSession, root: str) -> DataFrame:
    """Links of entities to chunks that the table has not yet."""
    return _linked(spark, root).links.join(_read(spark, root, "entity_chunks"), ["entity_id", "chunk_id"], "left_anti")


QUEUE = "id long, chunk_id long, name string, entity_type string, summary string, reasoning string, candidates array<long>, reason string, status string, created_at timestamp"


def _queue(spark: SparkSession, root: str) -> DataFrame:
    return L.queued(_linked(spark, root).actions, spark.createDataFrame([], QUEUE), AS_OF)


def review_queue(spark: SparkSession, root: str) -> DataFrame:
    page = L.review_page(_queue(spark, root), _read(spark, root, "chunks"), _read(spark, root, "conversations"))
    return page.select("id", "chunk_id", "name", "reason", "chunk_type", "conversation_id")


def _reviewed(spark: SparkSession, root: str) -> L.Reviewed:
    """Every third review is resolved to its first candidate (or entity 3), every third to a new entity, the rest dismissed."""
    queue = cut(_queue(spark, root))
    turn = F.col("id") % 3
    verdict = F.when(turn == 0, "existing").when(turn == 1, "new").otherwise("dismiss")
    decisions = queue.select(F.col("id").alias("review_id"), F.lit(AS_OF).cast("timestamp").alias("decided_at"), verdict.alias("verdict"), F.coalesce(F.get("candidates", F.lit(0)), F.lit(3)).alias("entity_id"), F.concat(F.lit("Reviewed "), F.lower(F.trim("name"))).alias("name"), "entity_type", F.lit("reviewed").alias("summary"))
    lost = decisions.limit(1).withColumn("review_id", F.lit(10**9).cast("long"))
    return L.reviewed(queue, decisions.unionByName(lost), _read(spark, root, "entities"))


def review_decisions(spark: SparkSession, root: str) -> DataFrame:
    return _reviewed(spark, root).queue.select("id", "status", "resolved_entity_id")


def review_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Entities as the reviews leave them: the number of aliases, and the new ones."""
    return _reviewed(spark, root).entities.select("id", "name", F.coalesce(F.size("aliases"), F.lit(0)).cast("long").alias("n_aliases"))


def review_errors(spark: SparkSession, root: str) -> DataFrame:
    return _reviewed(spark, root).errors


def add_relations(spark: SparkSession, root: str) -> DataFrame:
    """Requests by upper-case names of neighbouring ids: new edges, or why not."""
    e = _read(spark, root, "entities").filter("id > 2 AND name IS NOT NULL").select("id", F.upper("name").alias("name"))
    pairs = e.join(e.select((F.col("id") - 1).alias("id"), F.col("name").alias("target")), "id", "left").select(F.col("id").alias("request_id"), F.col("name").alias("source"), "target", F.lit("knows").alias("relation_type"), F.lit("asked").alias("description"))
    made, errors = L.added_relations(pairs, _read(spark, root, "entities"), _edges(spark, root))
    return made.select(F.lit(None).cast("long").alias("request_id"), "edge_id", "source_id", "target_id", F.lit(None).cast("string").alias("error")).unionByName(errors.select("request_id", F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("long").alias("target_id"), "error"))


def correct_relations(spark: SparkSession, root: str) -> DataFrame:
    """Every second edge gets a description, every third is closed, which goes first."""
    e = _edges(spark, root)
    patch = e.select("edge_id", (F.col("edge_id") % 3 == 0).alias("supersede"), F.when(F.col("edge_id") % 2 == 0, "better").alias("description"))
    return L.corrected_relations(e, patch, AS_OF).select("edge_id", F.col("superseded_at").isNotNull().alias("closed"), "description")


def correct_entities(spark: SparkSession, root: str) -> DataFrame:
    """Aliases for every fourth entity; every tenth asks for the name of the next one and is refused where the types agree."""
    e = _read(spark, root, "entities").select("id", "name", "entity_type", "summary", "aliases")
    after = e.select((F.col("id") - 1).alias("id"), F.col("name").alias("next"))
    patch = e.filter("id % 4 = 0 OR id % 10 = 0").join(after, "id", "left").select("id", F.when(F.col("id") % 10 == 0, F.col("next")).alias("name"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("summary"), F.when(F.col("id") % 4 == 0, F.lit("AKA")).alias("alias"))
    out, errors = L.corrected_entities(e, patch)
    return out.join(errors, "id", "left").select("id", "name", F.coalesce(F.size("aliases"), F.lit(0)).cast("long").alias("n_aliases"), "error")


def audit_report(spark: SparkSession, root: str) -> DataFrame:
    """The newest log row of each audit: how many findings, or why it failed (one of them always does)."""
    e, links, live = _read(spark, root, "entities"), _read(spark, root, "entity_chunks"), _edges(spark, root)
    checks = {
        "duplicates": lambda: A.similar_names(e.select(F.col("entity_type").alias("kind"), "name")),
        "orphans": lambda: A.orphans(e, links).select("id"),
        "broken": lambda: A.broken_relations(live, e.filter("id % 60 <> 0")),
        "repeated": lambda: A.repeated(live.unionByName(live.filter("edge_id % 40 = 0")), ["source_id", "target_id", "relation_type"], "edge_id", ["edge_id"]),
        "stale": lambda: A.stale(e, AS_OF).select("id"),
        "unknown": lambda: e.select("no such column"),
    }
    first = K.audit_log(spark, {k: checks[k] for k in ("orphans", "stale")}, "2026-05-01 00:00:00")
    log = first.unionByName(K.audit_log(spark, checks, AS_OF))
    return K.latest_audits(log).select("audit", F.date_format("run_at", "yyyy-MM-dd").alias("day"), "n", (F.col("error").isNotNull()).alias("failed"))


def recall_depths(spark: SparkSession, root: str) -> DataFrame:
    """Everything recall tells at depth 3."""
    hits = R.recall(_read(spark, root, "chunks"), QUERY, TERMS, AS_OF)
    return U.recall_report(cut(hits), 3, _read(spark, root, "chunks"), _read(spark, root, "entity_chunks"), _read(spark, root, "entities"), _read(spark, root, "conversations"), messages(session_rows(spark, root)))


def _recalled(spark: SparkSession, root: str, depth: int, chunk_type: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    folder = shared_folder(spark, "postings")
    U.build_postings(_read(spark, root, "chunks"), folder, buckets=16)
    tables = {n: _read(spark, root, n) for n in ("chunks", "entity_chunks", "entities", "conversations")} | {"messages": messages(session_rows(spark, root))}
    return U.recalled(spark, folder, "the indexing of a note", QUERY, depth, AS_OF, tables, 10, chunk_type, 16)


def recall_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """Hybrid recall with its keywords from the index of stems."""
    return _recalled(spark, root, 1)[0].select("id", *(F.round(x, 6).alias(x) for x in ("rrf_vector", "rrf_keyword", "final_score")))


def recall_of_type(spark: SparkSession, root: str) -> DataFrame:
    """The same among decisions, and the access events it leaves."""
    hits, _, log = _recalled(spark, root, 1, "decision")
    return log.select("kind", "id").unionByName(hits.select(F.lit("hit").alias("kind"), "id"))


def keyword_search_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """Twenty best chunks with all stems of the query, from an index of stems."""
    folder = shared_folder(spark, "postings")
    U.build_postings(_read(spark, root, "chunks"), folder, buckets=16)
    out = U.search_postings(spark, folder, "the indexing of a note", 20, 16)
    return out.select("id", F.round("score", 6).alias("score"), F.col("keyword_rank").cast("long"))


def keyword_match_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """All of them."""
    folder = shared_folder(spark, "postings")
    U.build_postings(_read(spark, root, "chunks"), folder, buckets=16)
    return U.match_postings(spark, folder, "noted, and indexed", 16).select("id")


def search_messages_ranked(spark: SparkSession, root: str) -> DataFrame:
    """Ten best messages of one source and quarter with all stems of the query."""
    out = U.search_messages(messages(session_rows(spark, root)), _read(spark, root, "conversations"), "importing notes", "2026-01-01", "2026-05-31", "cc", 10)
    return out.select("session_id", "rec_id", F.round("score", 6).alias("score"))


def get_entity(spark: SparkSession, root: str) -> DataFrame:
    """Two entities: one by number, one by part of its name."""
    e, links, chunks = _read(spark, root, "entities"), _read(spark, root, "entity_chunks"), _read(spark, root, "chunks")
    parts = [U.entity_report(e, asked, _edges(spark, root), links, chunks).withColumn("asked", F.lit(asked)) for asked in ("20", "Use")]
    return parts[0].unionByName(parts[1])


def neighbourhood_named(spark: SparkSession, root: str) -> DataFrame:
    """Two hops around a customer that is asked for by name, by what was bought and where one lives."""
    e = nodes(spark, root).withColumn("access_count", F.lit(0))
    return U.neighbourhood_report(e, "customer#000000001", edges(spark, root), 2, ["lives_in", "part_of"])


def boot_report(spark: SparkSession, root: str) -> DataFrame:
    """The day in Melbourne, the entities most used lately, and three counts."""
    return K.boot(_read(spark, root, "entities"), _read(spark, root, "conversations"), _read(spark, root, "chunks"), AS_OF, "Australia/Melbourne")


def topic_significance(spark: SparkSession, root: str) -> DataFrame:
    """Significance of the chunks after one more for each that begins a topic, five at most."""
    rows = _read(spark, root, "chunks").select("id", "conversation_id", F.when(F.size("embedding") == 64, F.col("embedding")).alias("embedding"), "significance")
    return K.topics_raised(rows, "conversation_id", "id").select("id", F.col("significance").cast("long"))


def entities_to_reconsolidate(spark: SparkSession, root: str) -> DataFrame:
    """People and organisations with at least five chunks."""
    return K.with_chunks(_read(spark, root, "entities"), _read(spark, root, "entity_chunks"), 5, ["Person", "Organisation"]).select("id", "n_chunks")


def reconsolidated(spark: SparkSession, root: str) -> DataFrame:
    """Their new summaries where they differ, and the counters."""
    made, counters = K.reconsolidated(_read(spark, root, "entities"), _read(spark, root, "entity_chunks"), _read(spark, root, "chunks"), 5, ["Person", "Organisation"])
    return counters


def exportable_conversations(spark: SparkSession, root: str) -> DataFrame:
    return K.exportable(_read(spark, root, "conversations"), ["chunked", "embedded"]).select("id", "pipeline_status")


def chunk_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation's number of messages that can be chunked, or what keeps it from being chunked."""
    said = messages(session_rows(spark, root)).withColumn("content", F.when(F.col("rec_id") % 1_000 != 0, F.col("content")))
    return K.chunk_outcomes(_read(spark, root, "conversations").select("id", "session_id"), said)


def deleted_entities(spark: SparkSession, root: str) -> DataFrame:
    """What deleting every ninth entity takes with it: links by cascade, and edges as refusals."""
    gone = _read(spark, root, "entities").filter("id % 9 = 0").select("id")
    links = K.cascaded(_read(spark, root, "entity_chunks"), "entity_id", gone)
    held = K.restricted(_edges(spark, root), "target_id", gone)
    return links.agg(F.count("*").alias("links")).join(held.agg(F.count("*").alias("held")), F.lit(True))


QUERIES = {
    f.__name__: f
    for f in (
        extraction_actions, extraction_relations, extraction_counters, extraction_rollup, extraction_links, review_queue, review_decisions, review_aliases, review_errors, add_relations, correct_relations, correct_entities, audit_report,
        recall_depths, recall_stemmed, recall_of_type, keyword_search_stemmed, keyword_match_stemmed, search_messages_ranked, get_entity, neighbourhood_named, boot_report, topic_significance, entities_to_reconsolidate, reconsolidated, exportable_conversations,
        chunk_outcomes, deleted_entities,
    )
}

_EDGES = """edge AS (SELECT id AS edge_id, 1 AS source_id, id AS target_id, 'uses' AS relation_type FROM entities WHERE id > 2 AND id % 20 = 0 UNION ALL SELECT 1, 1, id, 'works_at' FROM entities WHERE id = 5
UNION ALL SELECT id + 1, id, id - 1, 'knows' FROM entities WHERE id > 2 AND id % 30 = 0)"""
_P = """e AS (SELECT * FROM entities WHERE id > 2), p AS (SELECT id * 10 AS proposal_id, upper(name) AS name, entity_type FROM e UNION ALL SELECT id * 10 + 1, aliases[1], entity_type FROM e UNION ALL SELECT id * 10 + 2, name || 's', entity_type FROM e UNION ALL SELECT id * 10 + 3, 'zq' || id, entity_type FROM e)"""
_A = f"""WITH r AS ({CURATION['route_entities']}), {_P}, {_EDGES},
a AS (SELECT proposal_id, 1 + proposal_id % {CHUNKS} AS chunk_id, name, entity_type, CASE WHEN trim(name) = '' THEN 'reject' ELSE action END AS action, CASE WHEN trim(name) <> '' THEN entity_id END AS eid, reason FROM p JOIN r USING (proposal_id) WHERE name IS NOT NULL),
new AS (SELECT nm, tp, row_number() OVER (ORDER BY nm, tp) + (SELECT max(id) FROM entities) AS nid FROM (SELECT DISTINCT trim(name) AS nm, entity_type AS tp FROM a WHERE action = 'create_new')),
b AS (SELECT a.*, coalesce(nid, eid) AS entity_id FROM a LEFT JOIN new ON action = 'create_new' AND nm = trim(name) AND tp = entity_type),
m AS (SELECT chunk_id, lower(trim(name)) AS k, min(entity_id) AS t FROM b WHERE action IN ('singleton', 'apply_existing', 'create_new') GROUP BY ALL),
rel AS (SELECT proposal_id AS relation_id, b.chunk_id, {RELATIONS}[proposal_id % 4 + 1] AS kind, trim(name) <> '' AND proposal_id % 4 <> 3 AS sound, CASE WHEN lower(trim(name)) = 'user' THEN 1 WHEN lower(trim(name)) = 'assistant' THEN 2 ELSE m.t END AS t FROM b LEFT JOIN m ON m.chunk_id = b.chunk_id AND k = lower(trim(name))),
met AS (SELECT *, sound AND t IS NOT NULL AND t <> 1 AS good, (1, t, kind) IN (SELECT (source_id, target_id, relation_type) FROM edge) AS same FROM rel),
outcomes AS (SELECT relation_id, chunk_id, CASE WHEN good THEN 1 END AS source_id, CASE WHEN good THEN t END AS target_id, CASE WHEN NOT good OR same OR relation_id <> min(relation_id) FILTER (good AND NOT same) OVER (PARTITION BY kind, t) THEN 'skipped' WHEN kind = 'works_at' THEN 'superseded' ELSE 'created' END AS outcome FROM met),
counted AS (SELECT chunk_id, count(*) FILTER (action IN ('singleton', 'apply_existing')) AS entities_applied, count(*) FILTER (action = 'create_new') AS entities_created, count(*) FILTER (action = 'review') AS entities_reviewed, count(*) FILTER (action IN ('skip', 'reject')) AS entities_rejected,
  count(*) FILTER (outcome = 'created') AS relations_created, count(*) FILTER (outcome = 'superseded') AS relations_superseded, count(*) FILTER (outcome = 'skipped') AS relations_skipped, count(*) FILTER (b.proposal_id % 11 = 0) AS flags FROM b JOIN (SELECT relation_id AS proposal_id, outcome FROM outcomes) USING (proposal_id) GROUP BY 1)"""
_CAND = f"""{_A}, q AS (SELECT chunk_id, name, min(proposal_id) AS proposal_id FROM b WHERE action = 'review' GROUP BY ALL),
queue AS (SELECT row_number() OVER (ORDER BY proposal_id) AS id, q.chunk_id, q.name, b.entity_type, b.reason, b.eid FROM q JOIN b USING (proposal_id)),
said AS (SELECT *, id % 3 AS turn, 'Reviewed ' || lower(trim(name)) AS wanted, coalesce(eid, 3) AS cand FROM queue),
fresh AS (SELECT w, ty, row_number() OVER (ORDER BY w, ty) + (SELECT max(id) FROM entities) AS nid FROM (SELECT DISTINCT wanted AS w, entity_type AS ty FROM said WHERE turn = 1 AND (wanted, entity_type) NOT IN (SELECT (name, entity_type) FROM entities WHERE name IS NOT NULL AND entity_type IS NOT NULL)))"""
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_WORDS = rf"list_filter(string_split_regex(lower(coalesce(content, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND NOT list_contains([{_STOP}], t))"
_FORMS = {"index": "^index(es|ed|ing)?$", "note": "^not(e|es|ed|ing)$", "import": "^import(s|ed|ing|er|ers)?$"}


def _stemmed(of: str, *stems: str) -> str:
    """BM25 of the words of one stem each, as tf0, tf1 ... of the rows of a table."""
    tf = ", ".join(f"len(list_filter(t, lambda x: regexp_matches(x, '{_FORMS[s]}'))) AS tf{i}" for i, s in enumerate(stems))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(stems)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / al))" for i in range(len(stems)))
    return f"w AS (SELECT *, {_WORDS} AS t FROM {of}), f AS (SELECT *, {tf} FROM w), st AS (SELECT count(*) AS n, avg(len(t)) AS al, {df} FROM f), scored AS (SELECT *, {score} AS score FROM f, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(stems)))})"


def _hybrid(of: str, where: str) -> str:
    """Hits of hybrid recall over the stems of index and note."""
    return f"""{_varm(where)}, {_stemmed(of, 'index', 'note')}, karm AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS keyword_rank FROM scored WHERE {where} QUALIFY keyword_rank <= 20),
fused AS (SELECT id, vector_rank, keyword_rank, coalesce(1 / (60 + vector_rank), 0) AS rrf_vector, coalesce(1 / (60 + keyword_rank), 0) AS rrf_keyword FROM varm FULL JOIN karm USING (id)),
ranked AS (SELECT id, rrf_vector, rrf_keyword, vector_rank, keyword_rank, 0.6 * (rrf_vector + rrf_keyword) / max(rrf_vector + rrf_keyword) OVER () + 0.2 * {_REC} + 0.2 * coalesce(significance, 3) / 5 AS final_score FROM fused JOIN chunks USING (id)),
hits AS (SELECT * FROM ranked ORDER BY final_score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id LIMIT 10)"""


SQL = {
    "extraction_actions": f"{_A} SELECT proposal_id, chunk_id, action, entity_id FROM b",
    "extraction_relations": f"{_A} SELECT relation_id, chunk_id, source_id, target_id, outcome FROM outcomes",
    "extraction_counters": f"{_A} SELECT * FROM counted",
    "extraction_rollup": f"{_A} SELECT conversation_id, count(*) AS chunks, 0::BIGINT AS failed, {', '.join(f'sum({c})::BIGINT AS {c}' for c in L.COUNTERS)} FROM counted JOIN chunks k ON k.id = chunk_id GROUP BY 1",
    "extraction_links": f"{_A} SELECT DISTINCT entity_id, chunk_id FROM b WHERE action IN ('singleton', 'apply_existing', 'create_new') AND (entity_id, chunk_id) NOT IN (SELECT (entity_id, chunk_id) FROM entity_chunks)",
    "review_queue": f"{_CAND} SELECT q.id, q.chunk_id, q.name, q.reason, chunk_type, conversation_id FROM queue q JOIN chunks k ON k.id = q.chunk_id JOIN conversations c ON c.id = conversation_id ORDER BY q.id LIMIT 10",
    "review_errors": "SELECT 1000000000::BIGINT AS review_id, 'review not found' AS error",
    "add_relations": f"""WITH {_EDGES}, e AS (SELECT id, upper(name) AS name FROM entities WHERE id > 2 AND name IS NOT NULL), k AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS i FROM entities GROUP BY 1),
r AS (SELECT a.id AS request_id, a.name AS source, b.name AS target FROM e a LEFT JOIN e b ON b.id = a.id + 1), m AS (SELECT request_id, coalesce(x.n, 0) AS sn, x.i AS si, coalesce(y.n, 0) AS tn, y.i AS ti FROM r LEFT JOIN k x ON x.k = lower(trim(source)) LEFT JOIN k y ON y.k = lower(trim(target))),
z AS (SELECT *, CASE WHEN sn = 0 THEN 'source not found' WHEN sn > 1 THEN 'source is ambiguous' WHEN tn = 0 THEN 'target not found' WHEN tn > 1 THEN 'target is ambiguous' END AS error FROM m)
SELECT NULL::BIGINT AS request_id, row_number() OVER (ORDER BY request_id) + (SELECT max(edge_id) FROM edge) AS edge_id, si AS source_id, ti AS target_id, NULL::VARCHAR AS error FROM z WHERE error IS NULL UNION ALL SELECT request_id, NULL, NULL, NULL, error FROM z WHERE error IS NOT NULL""",
    "correct_relations": f"WITH {_EDGES} SELECT edge_id, bool_or(edge_id % 3 = 0) AS closed, CASE WHEN edge_id % 3 <> 0 AND edge_id % 2 = 0 THEN 'better' ELSE 'told' END AS description FROM edge GROUP BY edge_id, source_id, target_id, relation_type",
    "correct_entities": """WITH e AS (SELECT *, lead(name) OVER (ORDER BY id) AS nx, lead(id) OVER (ORDER BY id) = id + 1 AS follows FROM entities), w AS (SELECT *, CASE WHEN id % 10 = 0 AND follows THEN nx END AS want FROM e),
m AS (SELECT *, want IS NOT NULL AND want <> coalesce(name, '') AS moves FROM w), c AS (SELECT *, moves AND ((want, entity_type) IN (SELECT (name, entity_type) FROM entities WHERE name IS NOT NULL AND entity_type IS NOT NULL) OR count(*) FILTER (moves) OVER (PARTITION BY want, entity_type) > 1) AS clash FROM m)
SELECT id, CASE WHEN moves AND NOT clash THEN want ELSE name END AS name, (coalesce(len(aliases), 0) + CASE WHEN id % 4 = 0 AND NOT clash THEN 1 ELSE 0 END)::BIGINT AS n_aliases, CASE WHEN clash THEN 'name and type are taken' END AS error FROM c""",
    "audit_report": f"""WITH {_EDGES}, dup AS ({GRAPH['similar_entity_names']}), orph AS ({GRAPH['audit_orphans']}), stale AS ({GRAPH['audit_stale']}),
broken AS (SELECT edge_id FROM edge WHERE source_id NOT IN (SELECT id FROM entities WHERE id % 60 <> 0) UNION ALL SELECT edge_id FROM edge WHERE target_id NOT IN (SELECT id FROM entities WHERE id % 60 <> 0)),
twice AS (SELECT source_id FROM (SELECT * FROM edge UNION ALL SELECT * FROM edge WHERE edge_id % 40 = 0) GROUP BY source_id, target_id, relation_type HAVING count(*) > 1)
SELECT audit, '2026-06-01' AS day, n, n IS NULL AS failed FROM (SELECT 'duplicates' AS audit, count(*) AS n FROM dup UNION ALL SELECT 'orphans', count(*) FROM orph UNION ALL SELECT 'broken', count(*) FROM broken UNION ALL SELECT 'repeated', count(*) FROM twice
UNION ALL SELECT 'stale', count(*) FROM stale UNION ALL SELECT 'unknown', NULL)""",
    "recall_depths": f"""WITH {_RECALL}, {MESSAGES}, h AS (SELECT k.id AS chunk_id, conversation_id, k.content, start_ordinal, end_ordinal, c.session_id, c.name FROM hits JOIN chunks k USING (id) LEFT JOIN conversations c ON c.id = conversation_id)
SELECT chunk_id, 'entity' AS item, e.id AS ref, e.name AS detail FROM hits JOIN entity_chunks x ON x.chunk_id = hits.id JOIN entities e ON e.id = x.entity_id UNION ALL SELECT chunk_id, 'content', start_ordinal, content FROM h
UNION ALL SELECT chunk_id, 'conversation', conversation_id, name FROM h WHERE session_id IS NOT NULL UNION ALL SELECT chunk_id, 'message', rec_id, role FROM h JOIN msgs USING (session_id) WHERE ordinal BETWEEN start_ordinal AND least(end_ordinal, start_ordinal + 99)""",
    "recall_stemmed": f"WITH {_hybrid('chunks', 'TRUE')} SELECT id, round(rrf_vector, 6) AS rrf_vector, round(rrf_keyword, 6) AS rrf_keyword, round(final_score, 6) AS final_score FROM hits",
    "recall_of_type": f"""WITH {_hybrid('chunks', "chunk_type = 'decision'")} SELECT 'hit' AS kind, id FROM hits UNION ALL SELECT 'chunk', id FROM hits UNION ALL SELECT DISTINCT 'entity', entity_id FROM entity_chunks WHERE chunk_id IN (SELECT id FROM hits)""",
    "keyword_search_stemmed": f"WITH {_stemmed('chunks', 'index', 'note')} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS keyword_rank FROM scored QUALIFY keyword_rank <= 20",
    "keyword_match_stemmed": f"WITH {_stemmed('chunks', 'index', 'note')} SELECT id FROM scored",
    "search_messages_ranked": f"""WITH {MESSAGES}, own AS (SELECT msgs.session_id, rec_id, content FROM msgs JOIN conversations c ON c.session_id = msgs.session_id WHERE c.source = 'cc' AND spoken_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND spoken_at < TIMESTAMPTZ '2026-06-01 00:00:00+00'), {_stemmed('own', 'import', 'note')}
SELECT session_id, rec_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, rec_id) <= 10""",
    "get_entity": f"""WITH {_EDGES}, asked AS (SELECT '20' AS asked, 20::BIGINT AS eid UNION ALL SELECT 'Use', (SELECT id FROM entities WHERE contains(lower(name), 'use') ORDER BY lower(name) <> 'use', access_count DESC NULLS LAST, id LIMIT 1)),
top AS (SELECT asked, k.id, chunk_type FROM asked JOIN entity_chunks x ON x.entity_id = eid JOIN chunks k ON k.id = x.chunk_id QUALIFY row_number() OVER (PARTITION BY asked ORDER BY significance DESC NULLS FIRST, created_at DESC NULLS FIRST, k.id) <= 20)
SELECT asked, 'entity' AS part, eid AS ref, name || ' ' || entity_type AS detail FROM asked JOIN entities e ON e.id = eid UNION ALL SELECT asked, 'relation', edge_id, 'outbound ' || relation_type || ' ' || target_id FROM asked JOIN edge ON source_id = eid
UNION ALL SELECT asked, 'relation', edge_id, 'inbound ' || relation_type || ' ' || source_id FROM asked JOIN edge ON target_id = eid AND source_id <> eid UNION ALL SELECT asked, 'chunk', id, coalesce(chunk_type, '') FROM top""",
    "neighbourhood_named": f"""WITH me AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = 1), near AS (SELECT n_nationkey + 1000 AS id, n_name AS name, 1 AS depth FROM nation JOIN me ON n_nationkey = c_nationkey
UNION ALL SELECT customer.c_custkey + {CUSTOMER}, c_name, 2 FROM customer JOIN me USING (c_nationkey) WHERE customer.c_custkey <> me.c_custkey UNION ALL SELECT r_regionkey, r_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN me ON n_nationkey = c_nationkey)
SELECT 'entity' AS part, id AS ref, depth || ' ' || name AS detail FROM near UNION ALL SELECT 'total', depth, count(*)::VARCHAR FROM near GROUP BY depth UNION ALL SELECT 'relation', c_custkey + 1000000, 'lives_in' FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM me) UNION ALL SELECT 'relation', n_nationkey, 'part_of' FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM me)""",
    "boot_report": f"""WITH top AS (SELECT id, name FROM entities WHERE updated_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 7 DAYS AND access_count >= 3 ORDER BY access_count DESC, updated_at DESC, id LIMIT 10)
SELECT 'today' AS item, NULL::BIGINT AS ref, strftime(TIMESTAMPTZ '{AS_OF}+00' AT TIME ZONE 'Australia/Melbourne', '%Y-%m-%d') AS detail UNION ALL SELECT 'entity', id, name FROM top UNION ALL SELECT 'conversations', count(*), NULL FROM conversations
UNION ALL SELECT 'chunks', count(*), NULL FROM chunks UNION ALL SELECT 'open conversations', count(*), NULL FROM conversations WHERE pipeline_status NOT IN ('complete', 'extracted')""",
    "topic_significance": f"""{_PAIRS} SELECT c.id, (CASE WHEN similarity < 0.5 THEN least(coalesce(significance, 3) + 1, 5) ELSE significance END)::BIGINT AS significance FROM chunks c LEFT JOIN s ON s.id = c.id""",
    "entities_to_reconsolidate": "SELECT id, count(*) AS n_chunks FROM entities JOIN entity_chunks ON entity_id = id WHERE entity_type IN ('Person', 'Organisation') GROUP BY 1 HAVING count(*) >= 5",
    "reconsolidated": f"""WITH {_SUMMARY}, n AS (SELECT id FROM entities JOIN entity_chunks ON entity_id = id WHERE entity_type IN ('Person', 'Organisation') GROUP BY 1 HAVING count(*) >= 5)
SELECT count(*) AS considered, count(*) FILTER (made IS NOT NULL AND made IS DISTINCT FROM summary) AS updated, count(*) FILTER (NOT (made IS NOT NULL AND made IS DISTINCT FROM summary)) AS unchanged FROM n LEFT JOIN summed ON entity_id = id""",
    "exportable_conversations": "SELECT id, pipeline_status FROM conversations WHERE pipeline_status IN ('chunked', 'embedded')",
    "chunk_outcomes": f"""WITH {MESSAGES}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (rec_id % 1000 = 0) AS bad FROM msgs GROUP BY 1)
SELECT id AS conversation_id, CASE WHEN bad = 0 THEN n ELSE 0 END AS messages, CASE WHEN bad > 0 THEN bad || ' messages without content' WHEN n IS NULL THEN 'no messages' END AS error FROM (SELECT id, t.session_id, n, bad FROM conversations t LEFT JOIN c ON c.session_id = t.session_id)""".replace("CASE WHEN bad = 0 THEN n ELSE 0 END", "CASE WHEN bad = 0 THEN n ELSE 0 END::BIGINT"),
    "deleted_entities": f"WITH {_EDGES} SELECT (SELECT count(*) FROM entity_chunks WHERE entity_id % 9 <> 0) AS links, (SELECT count(*) FROM edge WHERE target_id IN (SELECT id FROM entities WHERE id % 9 = 0)) AS held",
    "review_decisions": f"""{_CAND} SELECT id, CASE turn WHEN 2 THEN 'dismissed' ELSE 'resolved' END AS status, CASE turn WHEN 0 THEN cand WHEN 1 THEN coalesce((SELECT min(x.id) FROM entities x WHERE x.name = wanted AND x.entity_type = said.entity_type), nid) END AS resolved_entity_id
FROM said LEFT JOIN fresh ON turn = 1 AND w = wanted AND ty = entity_type""",
    "review_aliases": f"""{_CAND}, more AS (SELECT cand AS id, list_distinct(list(said.name)) AS extra FROM said JOIN entities x ON x.id = cand WHERE turn = 0 AND said.name <> '' AND lower(said.name) <> lower(x.name) GROUP BY 1)
SELECT e.id, e.name, (coalesce(len(aliases), 0) + coalesce(len(list_filter(extra, lambda x: NOT coalesce(list_contains(aliases, x), FALSE))), 0))::BIGINT AS n_aliases FROM entities e LEFT JOIN more USING (id) UNION ALL SELECT nid, w, 0 FROM fresh""",
}
