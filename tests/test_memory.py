import pytest
from pyspark.sql import functions as F

from lorebase.operators import linking as L
from lorebase.operators import lookup as U
from lorebase.operators import upkeep as K
from lorebase.operators.graph import superseded
from lorebase.plans.memory import EDGE, QUEUE

ENTITIES = "id long, name string, entity_type string, summary string, aliases array<string>, access_count int"
NOW = "2026-06-01 00:00:00"


@pytest.fixture(scope="module")
def entities(spark):
    data = [(1, "User", "Person", None, None, 9), (2, "Assistant", "Person", None, None, 9), (3, "Docker", "Tool", "old", ["dk"], 3), (4, "Acme", "Organisation", None, None, 1), (5, "Bolt", "Organisation", None, None, 5), (6, "docker swarm", "Tool", None, None, 8), (7, None, "Tool", None, None, None)]
    return spark.createDataFrame([(*d, 0) for d in data], ENTITIES + ", chunk_id int")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 1, 3, "uses", "d", None, None), (2, 1, 4, "works_at", "d", None, None), (3, 3, 3, "part_of", None, None, None), (4, 4, 1, "knows", None, None, None)], EDGE)


def test_linking(spark, rows, entities, edges):
    proposals = spark.createDataFrame([
        (1, 10, "docker", "Tool", "existing", 0.9, "new text", "r"), (2, 10, "Zorp", "Tool", "new", 0.9, "z", None), (3, 11, " Zorp", "Tool", "new", 0.95, None, None), (4, 11, "Maybe", "Tool", "new", 0.2, None, "unsure"),
        (5, 11, "", "Tool", "new", 0.9, None, None), (6, 11, "Bad", "Nonsense", "new", 0.9, None, None), (7, 12, "user", "Person", "existing", 0.1, None, None), (8, 12, "Bolt", "Organisation", "existing", 0.8, None, None), (9, 12, "Corp", "Organisation", "new", 0.9, None, None),
        (10, 12, "Maybe", "Tool", "new", 0.2, None, None), (11, 12, "Maybe", "Tool", "new", 0.3, None, None), (12, 13, "noise", "Tool", "new", 0.99, None, None), (13, 13, None, None, None, None, None, None),
    ], "proposal_id long, chunk_id long, name string, entity_type string, match string, confidence double, summary string, reasoning string")
    relations = spark.createDataFrame([
        (1, 10, "User", "docker", "uses"), (2, 10, "user", "zorp", "uses"), (3, 11, "User", "Zorp", "uses"), (4, 10, "User", "nobody", "uses"), (5, 10, "User", "User", "knows"), (6, 10, "User", "docker", "bogus"), (7, 12, "User", "Bolt", "works_at"), (8, 12, "User", "Corp", "works_at"), (9, 12, None, None, None),
    ], "relation_id long, chunk_id long, source string, target string, relation_type string").withColumns({"description": F.lit(None).cast("string"), "valid_from": F.lit(None).cast("timestamp")})
    denied = spark.createDataFrame([("Noise", "Tool")], "name string, entity_type string")
    out = L.linked(proposals, relations, entities, denied, edges, spark.createDataFrame([(10,), (10,), (14,)], "chunk_id long"))
    acted = {r.proposal_id: (r.action, r.entity_id) for r in out.actions.collect()}
    new = {r.name: r.id for r in out.entities.collect()}
    assert sorted(new) == ["Corp", "Zorp"] and set(new.values()) == {8, 9}
    assert acted == {1: ("apply_existing", 3), 2: ("create_new", new["Zorp"]), 3: ("create_new", new["Zorp"]), 4: ("review", None), 5: ("reject", None), 6: ("reject", None), 7: ("singleton", 1), 8: ("apply_existing", 5), 9: ("create_new", new["Corp"]), 10: ("review", None), 11: ("review", None), 12: ("skip", None), 13: ("reject", None)}
    assert rows(out.summaries) == [(3, "new text")]
    assert rows(out.links) == sorted([(3, 10), (new["Zorp"], 10), (new["Zorp"], 11), (1, 12), (5, 12), (new["Corp"], 12)])
    assert {r.relation_id: r.outcome for r in out.relations.collect()} == {1: "skipped", 2: "created", 3: "skipped", 4: "skipped", 5: "skipped", 6: "skipped", 7: "superseded", 8: "superseded", 9: "skipped"}
    made = {(r.target_id, r.relation_type): r for r in out.edges.collect()}
    assert set(made) == {(new["Zorp"], "uses"), (5, "works_at"), (new["Corp"], "works_at")}
    bolt, corp = made[5, "works_at"], made[new["Corp"], "works_at"]
    assert bolt.next_edge == corp.edge_id and corp.next_edge is None and rows(out.closed) == [(2, bolt.edge_id)]
    assert rows(out.edge_links) == sorted([(1, 10), (made[new["Zorp"], "uses"].edge_id, 10), (made[new["Zorp"], "uses"].edge_id, 11), (bolt.edge_id, 12), (corp.edge_id, 12)])
    counters = {r.chunk_id: tuple(r[c] for c in L.COUNTERS) for r in out.counters.collect()}
    assert counters == {10: (1, 1, 0, 0, 1, 0, 4, 2), 11: (0, 1, 1, 2, 0, 0, 1, 0), 12: (2, 1, 2, 0, 0, 2, 1, 0), 13: (0, 0, 0, 2, 0, 0, 0, 0), 14: (0, 0, 0, 0, 0, 0, 0, 1)}
    chunks = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (15, 2), (16, 3)], "id long, conversation_id long")
    rolled = {r.conversation_id: (r.chunks, r.failed, r.entities_applied, r.flags) for r in L.rolled_up(out.counters, chunks, spark.createDataFrame([(15, "x")], "chunk_id long, error string")).collect()}
    assert rolled == {1: (2, 0, 1, 2), 2: (2, 1, 2, 0)}
    empty = L.linked(proposals.limit(0), relations.limit(0), entities, denied, edges)
    assert empty.counters.count() == 0 and empty.edges.count() == 0

    queue = L.queued(out.actions, spark.createDataFrame([(1, 11, "Maybe", "Tool", None, None, None, "x", "pending", None)], QUEUE), NOW)
    assert rows(queue, "id", "chunk_id", "name", "status") == [(2, 12, "Maybe", "pending")]


def test_reviews(spark, rows, entities):
    queue = spark.createDataFrame([
        (1, 10, "Dok", "Tool", None, "sounds like it", [3, 6], "similar", "pending"), (2, 11, "Quux", "Tool", None, None, None, "below", "pending"), (3, 12, "Hm ", "Tool", None, None, None, "below", "pending"), (4, 12, "x", "Tool", None, None, None, "below", "resolved"),
        (5, 12, "y", "Tool", None, None, None, "below", "pending"), (6, 12, "Acme", "Tool", None, None, [4], "other", "pending"),
    ], QUEUE.replace(", created_at timestamp", "")).withColumn("created_at", F.lit(NOW).cast("timestamp"))
    decisions = spark.createDataFrame([
        (1, 2, "existing", 3, None, None, None), (1, 3, "dismiss", None, None, None, None), (2, 1, "new", None, " Quux ", "Tool", "s"), (3, 1, "dismiss", None, None, None, None), (4, 1, "dismiss", None, None, None, None),
        (5, 1, "existing", 99, None, None, None), (9, 1, "dismiss", None, None, None, None), (6, 1, "new", None, "Acme", "Organisation", "known"),
    ], "review_id long, decided_at int, verdict string, entity_id long, name string, entity_type string, summary string")
    out = L.reviewed(queue, decisions, entities)
    assert rows(out.queue, "id", "status", "resolved_entity_id") == [(1, "resolved", 3), (2, "resolved", 8), (3, "dismissed", None), (4, "resolved", None), (5, "pending", None), (6, "resolved", 4)]
    assert {r.id: r.rejected for r in out.queue.collect()}[1] == [6]
    after = {r.id: r for r in out.entities.collect()}
    assert after[3].aliases == ["dk", "Dok"] and after[8].name == "Quux" and after[4].summary == "known" and after[4].aliases is None and len(after) == 8
    assert rows(out.links) == [(3, 10), (4, 12), (8, 11)]
    assert rows(out.examples) == [("Acme", 4, ""), ("Dok", 3, "sounds like it"), ("Quux", 8, "")]
    assert rows(out.denials) == [("hm", "Tool", "dismissed review 3")]
    assert rows(out.errors) == [(4, "review is already resolved"), (5, "entity not found"), (9, "review not found")]
    chunks = spark.createDataFrame([(10, 1, "c", "topic", 3), (11, 1, "c", "topic", 3), (12, 7, "c", "topic", 3)], "id long, conversation_id long, raw_content string, chunk_type string, significance int")
    talks = spark.createDataFrame([(1, "t")], "id long, name string")
    assert rows(L.review_page(queue, chunks, talks, limit=0), "id", "conversation_name") == [(1, "t")]
    assert rows(L.review_page(queue, chunks, talks), "id") == [(1,), (2,)]


def test_corrections(spark, rows, entities, edges):
    requests = spark.createDataFrame([(1, "docker", " ACME ", "uses", None), (2, "none", "Acme", "uses", None), (3, "Docker", "Acme", "bogus", None), (4, "Acme", "Docker", "uses", "x"), (5, "twin", "Acme", "uses", None)], "request_id long, source string, target string, relation_type string, description string")
    twins = entities.select("id", "name").union(spark.createDataFrame([(20, "Twin"), (21, "tWin")], "id long, name string"))
    made, errors = L.added_relations(requests, twins, edges)
    assert rows(made, "edge_id", "source_id", "target_id") == [(5, 3, 4), (6, 4, 3)]
    assert rows(errors) == [(2, "source not found"), (3, "relation_type is unknown"), (5, "source is ambiguous")]
    patch = spark.createDataFrame([(1, True, "ignored"), (2, False, "better"), (3, None, None)], "edge_id long, supersede boolean, description string")
    assert rows(L.corrected_relations(edges, patch, NOW), "edge_id", F.col("superseded_at").isNotNull(), "description") == [(1, True, "d"), (2, False, "better"), (3, False, None), (4, False, None)]
    patch = spark.createDataFrame([(3, None, None, "sum", "dk"), (4, "Bolt", None, None, "a"), (5, "Newbolt", None, None, None), (6, "Same", None, None, None), (7, "Same", None, None, None), (99, "x", None, None, None)], "id long, name string, entity_type string, summary string, alias string")
    out, errors = L.corrected_entities(entities, patch)
    got = {r.id: r for r in out.collect()}
    assert got[3].summary == "sum" and got[3].aliases == ["dk", "dk"] and got[4].name == "Acme" and got[4].aliases is None and got[5].name == "Newbolt" and got[6].name == "docker swarm"
    assert rows(errors) == [(4, "name and type are taken"), (6, "name and type are taken"), (7, "name and type are taken"), (99, "entity not found")]


def test_lookups(spark, rows, entities, edges):
    pick = lambda asked: [r.id for r in U.resolved_entity(entities, asked).collect()]
    assert [pick(x) for x in ("3", " docker", "DOCK", "99", " ", "swarm", "%")] == [[3], [3], [6], [], [], [6], []]
    chunks = spark.createDataFrame([(10, 1, None, "topic"), (11, 2, None, None)], "id long, significance int, created_at timestamp, chunk_type string")
    links = spark.createDataFrame([(3, 10), (3, 11)], "entity_id long, chunk_id long")
    assert rows(U.entity_report(entities, "docker", edges, links, chunks)) == [("chunk", 10, "topic"), ("chunk", 11, ""), ("entity", 3, "Docker Tool"), ("relation", 1, "inbound uses 1"), ("relation", 3, "outbound part_of 3")]
    near = rows(U.neighbourhood_report(entities, "docker", edges, 9))
    assert [r for r in near if r[0] == "total"] == [("total", 1, "1"), ("total", 2, "1")] and ("entity", 4, "2 Acme") in near
    assert rows(U.neighbourhood_report(entities, "nothing", edges)) == []


def test_index(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "Indexing the notes, noted"), (2, "an index"), (3, None), (4, "the"), (5, "notes of an indexed note " + "word " * 2_000)], "id long, content string")
    U.build_postings(df, str(tmp_path), buckets=4)
    assert rows(U.search_postings(spark, str(tmp_path), "Index, note!", 5, 4), "keyword_rank", "id") == [(1, 1), (2, 5)]
    assert U.search_postings(spark, str(tmp_path), "the of", 5, 4).count() == 0 and U.search_postings(spark, str(tmp_path), "zebra", 5, 4).count() == 0
    assert spark.read.parquet(f"{tmp_path}/sizes").first().docs == 5
    said = spark.createDataFrame([("s", 1, "Indexes noted", "2026-03-31 23:00:00"), ("s", 2, "index notes", "2026-04-01 00:00:00"), ("t", 3, "index note", None)], "session_id string, rec_id long, content string, at string").withColumn("spoken_at", F.col("at").cast("timestamp"))
    talks = spark.createDataFrame([("s", "a"), ("t", "b")], "session_id string, source string")
    find = lambda *how, **kw: sorted(r.rec_id for r in U.search_messages(said, talks, *how, **kw).collect())
    assert find("note index", "2026-01-01", "2026-03-31") == [1] and find("note index") == [1, 2, 3] and find("note", source="b") == [3] and find(" the ") == [] and len(find("note", limit=0)) == 1


def test_all_matches_of_the_index(spark, rows, tmp_path):
    """All matches need no room for an order of all of them, nor one task that makes it."""
    from lorebase.plans.memory import SQL, keyword_match_stemmed, keyword_search_stemmed
    from tests.oracle import same, tables

    texts = {0: "an index of notes", 1: "noted, indexed, noting", 2: "note", 3: "indexes", 4: "", 5: None}
    df = spark.createDataFrame([(i, texts[i % 6]) for i in range(300)], "id long, content string")
    df.repartition(3).write.parquet(f"{tmp_path}/chunks.parquet")
    con = tables(tmp_path)
    out = keyword_match_stemmed(spark, str(tmp_path))
    assert rows(out) == [(i,) for i in range(300) if i % 6 < 2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan
    same(out, con, SQL["keyword_match_stemmed"])
    same(keyword_search_stemmed(spark, str(tmp_path)), con, SQL["keyword_search_stemmed"])
    U.build_postings(df, f"{tmp_path}/index", buckets=4)
    none = U.match_postings(spark, f"{tmp_path}/index", "of the", 4)
    assert none.columns == ["id", "score"] and none.count() == 0
    U.build_postings(df.limit(0), f"{tmp_path}/empty", buckets=4)
    assert U.match_postings(spark, f"{tmp_path}/empty", "index", 4).count() == 0 and U.search_postings(spark, f"{tmp_path}/empty", "index", 5, 4).count() == 0


def test_upkeep(spark, rows, tmp_path):
    frame = spark.createDataFrame([(1,), (2,)], "id long")
    log = K.audit_log(spark, {"two": lambda: frame, "broken": lambda: frame.select("nope")}, NOW, 1)
    assert rows(log.select("audit", "n", "findings")) == [("broken", None, None), ("two", 2, '[{"id":1}]')]
    later = K.audit_log(spark, {"two": lambda: frame.limit(0)}, "2026-07-01 00:00:00")
    assert rows(K.latest_audits(log.unionByName(later)).select("audit", "n")) == [("broken", None), ("two", 0)]
    kids = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "k long, parent long")
    gone = spark.createDataFrame([(7,)], "id long")
    assert rows(K.cascaded(kids, "parent", gone), "k") == [(2,), (3,)] and rows(K.nulled(kids, "parent", gone)) == [(1, None), (2, 8), (3, None)] and rows(K.restricted(kids, "parent", gone), "k") == [(1,)]
    assert rows(K.replaced(kids, spark.createDataFrame([(9, 8)], "k long, parent long"), "parent")) == [(1, 7), (3, None), (9, 8)]
    assert rows(K.without_keys(spark.createDataFrame([("a", "x"), ("b", "y")], "key string, content string"), [" a "])) == [("b", "y")]
    ran = []
    steps = {"001": lambda s: ran.append(1), "002": lambda s: ran.append(2)}
    assert K.applied_once(spark, f"{tmp_path}/log", {"001": steps["001"]}) == ["001"] and K.applied_once(spark, f"{tmp_path}/log", steps) == ["002"] and K.applied_once(spark, f"{tmp_path}/log", steps) == [] and ran == [1, 2]
    with pytest.raises(ZeroDivisionError):
        K.applied_once(spark, f"{tmp_path}/log", {"003": lambda s: 1 / 0})
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0], 3), (2, 1, [1.0, 0.0], 3), (3, 1, [0.0, 1.0], 3), (4, 1, [1.0, 0.0], 5), (5, 1, None, 2), (6, 1, [0.0, 1.0], None)], "id long, c long, embedding array<float>, significance int")
    assert rows(K.topics_raised(vectors, "c", "id"), "id", "significance") == [(1, 3), (2, 3), (3, 4), (4, 5), (5, 2), (6, 4)]


def test_timelines_by_stretches(spark):
    data = [(k, i, f"2026-01-{1 + (i * 7) % 28:02d}") for k in ("a", None) for i in range(40)] + [("a", 98, None), ("a", 99, None)]
    df = spark.createDataFrame(data, "k string, i long, d string").withColumn("d", F.col("d").cast("date"))
    for days in (1, 5, 1_000):
        got = {(r.k, r.i): r.superseded_by for r in superseded(df, ["k"], "d", "i", days).collect()}
        for k in ("a", None):
            own = sorted((d or "", i) for key, i, d in data if key == k)
            assert all(got[k, i] == (own[n + 1][1] if n + 1 < len(own) else None) for n, (_, i) in enumerate(own))


def test_log_lines_across_blocks(spark, tmp_path):
    """A file that several tasks share has the line numbers of the whole file."""
    from lorebase.sources.records import session_log_lines

    lines = [f"line {i} " + "x" * (i % 50) if i % 4 else "" for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("only\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        out = session_log_lines(spark, str(tmp_path))
        assert spark.read.text(f"{tmp_path}/a.jsonl").rdd.getNumPartitions() > 5
        got = {(r.path[-7:], r.line_no): r.line for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {("a.jsonl", i): x for i, x in enumerate(lines) if x} | {("b.jsonl", 0): "only"}


def test_imports_and_exports(spark, rows, tmp_path):
    from lorebase.sources import records as R

    chunks = spark.createDataFrame([(1, 10, "a", "topic", 3, 0), (2, 10, "b", "topic", 3, 1), (3, 11, "c", "topic", 3, 0)], "id long, conversation_id long, raw_content string, chunk_type string, significance int, start_ordinal int")
    entity = "array<struct<name:string>>"
    results = spark.createDataFrame([("f", 10, 1, [("x",)], None, None), ("f", 10, 2, [("x",), ("y",)], [("z",)], None), ("g", 11, 1, [("x",)], None, None), ("g", 11, None, None, None, "chunk_id is missing")], f"path string, conversation_id long, chunk_id long, entities {entity}, relations {entity}, error string")
    assert rows(R.import_report(results, chunks)) == [(10, 2, 2, 0, 0, 3, 1, True), (11, 1, 0, 1, 1, 0, 0, False)]
    talks = spark.createDataFrame([(10, "complete"), (11, None)], "id long, pipeline_status string")
    R.export_chunks(chunks, str(tmp_path), talks, prompt="Do it.")
    assert rows(spark.read.json(f"{tmp_path}/chunks").select("id")) == [(3,)] and spark.read.text(f"{tmp_path}/_prompt").first().value == "Do it."
    batch = spark.createDataFrame([("A ",), ("a",), ("b",), ("c",)], "session_id string")
    said = spark.createDataFrame([("a", "1"), ("B", "2"), ("c", "3")], "session_id string, content string")
    fresh, messages = R.appended(batch, said, spark.createDataFrame([("C",)], "session_id string"))
    assert fresh.count() == 2 and rows(messages) == [("B", "2"), ("a", "1")]
    assert rows(R.missing(spark.createDataFrame([(1,), (1,), (7,), (7,), (None,)], "id long"), chunks)) == [(7,)]


def test_linking_broadcasts_no_table(spark, entities, edges, monkeypatch):
    """Whatever sizes are guessed from the files: only single rows and the sizes of tasks (next_ids) are broadcast."""
    from lorebase.operators import curation as C

    plans = []

    def seen(df):
        made = session.cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made

    from lorebase import session

    for module in (L, C):
        monkeypatch.setattr(module, "cut", seen)
    proposals = spark.createDataFrame([(1, 10, "docker", "Tool", "existing", 0.9, None, None), (2, 10, "Zorp", "Tool", "new", 0.9, "z", None), (3, 10, "dockers", "Tool", "new", 0.9, "z", None)], "proposal_id long, chunk_id long, name string, entity_type string, match string, confidence double, summary string, reasoning string")
    relations = spark.createDataFrame([(1, 10, "User", "docker", "uses", None, None), (2, 10, "User", "Zorp", "works_at", None, None)], "relation_id long, chunk_id long, source string, target string, relation_type string, description string, valid_from timestamp")
    out = L.linked(proposals, relations, entities, spark.createDataFrame([("Noise", "Tool")], "name string, entity_type string"), edges)
    out.counters.collect(), out.edge_links.collect()
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (out.counters, out.edge_links)]
    assert len(plans) > 9
    wide = [line for plan in plans for line in plan.splitlines() if "BroadcastExchange" in line and "IdentityBroadcastMode" not in line and "HashedRelationBroadcastMode(List(input[0, bigint" not in line]
    assert not [p for p in plans if "BroadcastHashJoin" in p and "__part" not in p] and not wide, wide


def test_fuzzy_candidates_are_all_found(spark, rows):
    import random

    from lorebase.functions.text import trigram_similarity
    from lorebase.operators.curation import fuzzy_candidates

    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
    name = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    entities = spark.createDataFrame([(i, name(), r.choice(["Tool", "Place"])) for i in range(150)], "id long, name string, entity_type string")
    asked = spark.createDataFrame([(i, name(), r.choice(["Tool", "Place"])) for i in range(150)], "proposal_id long, name string, entity_type string")
    pairs = asked.join(entities.withColumnRenamed("name", "known"), "entity_type").withColumn("s", trigram_similarity("name", "known"))
    for least in (0.3, 0.6):
        found = fuzzy_candidates(asked, entities, least, 1_000).select("proposal_id", F.explode("fuzzy").alias("id"))
        want = rows(pairs.filter(F.col("s") > least), "proposal_id", "id")
        assert len(want) > 9 and rows(found) == want


def test_results_in_lines(spark, rows, tmp_path, monkeypatch):
    import json
    from pathlib import Path

    from lorebase.plans import ingest
    from lorebase.sources import records as R

    said = [{"conversation_id": 4, "chunks": [{"chunk_id": 1, "entities": [{"name": "A\nB", "entity_type": "Tool"}]}, {"entities": []}]}, {"conversation_id": 5, "chunks": [{"chunk_id": 2}]}, {"chunks": [{"chunk_id": 3}]}]
    (tmp_path / "result_1.json").write_text("\n".join(map(json.dumps, said[:2])) + "\n \n{broken\n")
    (tmp_path / "result_2.json").write_text(json.dumps(said[2]))
    results = R.extraction_results(spark, str(tmp_path), lines=True)
    assert rows(results, "conversation_id", "chunk_id", "error") == [(4, 1, None), (4, None, "chunk_id is missing"), (5, 2, None), (None, 3, "conversation_id is missing"), (None, None, "unreadable")]

    # 3,000 results of 30 conversations, those of three unreadable; the batch is written in as many files as tasks, not as results
    chunks = spark.range(0, 3_000_000, 1_000).select("id", (F.col("id") / 1_000 % 30).cast("long").alias("conversation_id"))
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    monkeypatch.setattr(ingest, "shared_folder", lambda spark, name: str(tmp_path / name))
    out = {r.conversation_id: r for r in ingest.result_import(spark, str(tmp_path)).collect()}
    assert set(out) == {c for c in range(31) if c % 9} and all(r.errors == 0 for r in out.values())
    want = chunks.withColumn("said", F.col("conversation_id") + 1).groupBy("said").count().filter("said % 9 <> 0")
    assert {(k, r.chunks, r.foreign) for k, r in out.items() if r.chunks} == {(r.said, r["count"], r["count"]) for r in want.collect()}
    assert 0 < len(list(Path(tmp_path / "results").rglob("*.txt"))) <= 200


def test_checkpoint_folder_is_shared_or_local(spark, monkeypatch):
    from lorebase import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Cluster:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())
