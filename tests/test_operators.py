import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lorebase.functions.messages import content_text, identifier, not_blank, parsed
from lorebase.functions.text import porter_stem, trigram_similarity
from lorebase.functions.vectors import cosine_similarity
from lorebase.operators import chunking as K
from lorebase.operators import curation as C
from lorebase.operators import graph as G
from lorebase.operators.audits import similar_names
from lorebase.operators.dedupe import deduplicated, new_rows, surplus_rows
from lorebase.operators.ordinals import context_rows, dense_ordinals, previous, running_sum
from lorebase.operators.shred import entities, shred
from lorebase.sources import records as R


def test_deduplication(spark, rows):
    df = spark.createDataFrame([(5, "a", "x", 1), (2, "a", "x", 2), (9, "a", "x", 0), (3, None, "x", 0), (4, None, "x", 0), (7, "b", None, 0), (8, "b", "y", 0)], "rec_id long, s string, u string, rn int")
    assert rows(surplus_rows(df, ["s", "u"], "rec_id")) == [(5,), (9,)]
    assert rows(surplus_rows(df, ["s", "u"], "rec_id", ["rn"])) == [(2,), (5,)]
    assert rows(deduplicated(df, ["s", "u"], ["rec_id"]), "rec_id") == [(2,), (3,), (4,), (7,), (8,)]
    assert surplus_rows(df.limit(0), ["s", "u"], "rec_id").count() == 0
    stored = df.filter("u = 'y'")
    assert rows(new_rows(df, stored, ["s", "u"], ["rec_id"]), "rec_id") == [(2,), (3,), (4,), (7,)]


def test_hot_identifier_is_cut_before_the_exchange(spark):
    df = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("u"))
    found = surplus_rows(df, ["u"], "rec_id")
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert found.count() == 9_999


NESTED = {"role": "user", "content": [{"type": "tool_use", "id": "t1", "input": {"a": [1, {"b": None}]}}, {"type": "text", "text": "hi \ud800"}, "bare", 3]}


def test_shredding(spark, rows):
    deep = "[" * 3_000 + "]" * 3_000
    df = spark.createDataFrame([(1, json.dumps(NESTED), "n"), (2, json.dumps(json.dumps({"role": "x", "content": {"type": "text", "text": "t"}})), "n"), (3, "{broken", "n"), (4, None, "n"), (5, "", "n"), (6, deep, "n"), (7, "[]", "n"), (8, '"just text"', "n")], "k long, j string, node string")
    nodes = shred(df, ["k"], "j").cache()
    one = rows(nodes.filter("k = 1"), "node", "parent", "label", "ordinal", "kind", "path", "scalar")
    assert one[0] == (0, None, None, 0, "object", "", None)
    assert (5, 3, "id", 1, "string", "content[].id", "t1") in one
    assert (10, 9, "b", 0, "null", "content[].input.a[].b", None) in one
    assert {r[0] for r in rows(nodes.filter("kind = 'invalid'"), "k")} == {3, 5} | ({6} if rows(nodes.filter("k = 6 AND kind = 'invalid'"), "k") else set())
    assert nodes.filter("k = 4").count() == 0 and nodes.filter("k = 8").count() == 1
    # every node's parent is there
    orphans = nodes.filter("parent IS NOT NULL").join(nodes.select("k", F.col("node").alias("parent")), ["k", "parent"], "left_anti")
    assert orphans.count() == 0
    table = entities(nodes, ["k"], ["content[]", "content"], ["type", "id", "text", "input"], raw=["input"])
    assert rows(table, "k", "node", "parent", "ordinal", "type", "id", "text", "kind_input") == [(1, 3, 2, 0, "tool_use", "t1", None, "object"), (1, 11, 2, 1, "text", None, "hi ?", None), (2, 2, 0, 1, "text", None, "t", None)]
    # a projection of paths changes neither numbers nor tables
    slim = shred(df, ["k"], "j", ["content[]", "content", "content[].type", "content.type"])
    assert rows(entities(slim, ["k"], ["content[]", "content"], ["type"]), "k", "node", "type") == rows(table, "k", "node", "type")
    assert shred(df.limit(0), ["k"], "j").count() == 0


def rebuild(nodes):
    values, root = {}, None
    for node, parent, label, _, kind, scalar in sorted(nodes):
        value = {"object": dict, "array": list}.get(kind, lambda k=kind, s=scalar: None if k == "null" else s if k == "string" else json.loads(s))()
        values[node] = value
        if parent is None:
            root = value
        elif isinstance(values[parent], dict):
            values[parent][label] = value
        else:
            values[parent].append(value)
    return root


def test_shredding_round_trip(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, rng.randint(-9, 9), round(rng.random(), 3), rng.choice(["", "é", "a.b", "[]"])][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    records = [[value(4)] for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k long, j string")
    got = {}
    for k, *node in shred(df, ["k"], "j").select("k", "node", "parent", "label", "ordinal", "kind", "scalar").collect():
        got.setdefault(k, []).append(tuple(node))
    assert [rebuild(got[i]) for i in range(len(records))] == records


def test_message_text(spark, rows):
    texts = ['{"content":"plain"}', '{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}', '{"content":{"type":"text","text":"one"}}', json.dumps('{"content":"twice"}'), '{"content":null}', "{", None, '{"content":[]}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, m string").withColumn("v", parsed("m"))
    got = dict(df.select("k", content_text("v")).collect())
    assert got == {0: "plain", 1: "a\nb", 2: "one", 3: "twice", 4: None, 5: None, 6: None, 7: ""}
    assert [r[0] for r in df.filter(not_blank(content_text("v"))).select("k").collect()] == [0, 1, 2, 3]
    assert spark.createDataFrame([("  AbC ",), (" ",), (None,)], "i string").select(identifier("i")).collect() == [("abc",), (None,), (None,)]


@pytest.mark.parametrize("width", [1, 3, 1_000])
def test_prefixes_by_stretches(spark, rows, width):
    rng = random.Random(width)
    data = [(g, o, rng.randrange(5)) for g in "ab" for o in rng.sample(range(50), 20)]
    df = spark.createDataFrame(data, "g string, o long, x long")
    want_ordinal, want_sum, want_prev = {}, {}, {}
    for g in "ab":
        total, before = 0, None
        for i, (_, o, x) in enumerate(sorted(d for d in data if d[0] == g)):
            total += x
            want_ordinal[g, o], want_sum[g, o], want_prev[g, o] = i, total, before
            before = x
    assert {(g, o): n for g, o, n in dense_ordinals(df, ["g"], "o", "n", width).select("g", "o", "n").collect()} == want_ordinal
    assert {(g, o): n for g, o, n in running_sum(df, ["g"], "o", "x", "n", width).select("g", "o", "n").collect()} == want_sum
    assert {(g, o): n for g, o, n in previous(df, ["g"], "o", ["x"], width).select("g", "o", "prev_x").collect()} == want_prev


def test_context(spark, rows):
    df = spark.range(6).select(F.lit("s").alias("s"), F.col("id").alias("o"))
    assert rows(context_rows(df, df.filter("o = 1"), "s", "o"), "o") == [(0,), (1,), (2,), (3,)]


def fold(said):
    """The chunk rules over one conversation, message by message."""
    build = lambda ms: "\n\n".join(f"{'Human' if m['role'] == 'human' else 'Assistant'}: {m['content']}" for m in ms)
    size = lambda t: len(t) // 4
    gap = lambda a, b: a["t"] is not None and b["t"] is not None and b["t"] - a["t"] > 1800
    turns = []
    for m in said:
        if not turns or m["role"] == "human" or gap(turns[-1][-1], m):
            turns.append([])
        turns[-1].append(m)
    merged = []
    boot = bool(turns) and turns[0][0]["role"] == "human" and turns[0][0]["content"].lower().startswith("hello")
    for i, t in enumerate(turns):
        n = size(build(t))
        if merged and n < 150 and not (boot and i <= 1) and size(build(merged[-1])) + n < 150 and not gap(merged[-1][-1], t[0]):
            merged[-1] = merged[-1] + t
        else:
            merged.append(t)
    return [(m[0]["o"], m[-1]["o"]) for m in merged]


def test_chunks_against_a_plain_fold(spark):
    rng, data = random.Random(9), []
    for s in range(12):
        clock = 0.0
        for o in range(rng.randrange(1, 30)):
            clock += rng.choice([10, 60, 4_000])
            text = rng.choice(["hello there", "ok", "x " * rng.randrange(1, 120), "y" * rng.randrange(1, 400)])
            data.append((f"s{s}", o, s * 1_000 + o, rng.choice(["human", "assistant"]), text, None if rng.random() < 0.1 else clock))
    df = spark.createDataFrame(data, "session_id string, ordinal long, rec_id long, role string, content string, t double").withColumn("spoken_at", F.timestamp_seconds("t")).drop("t")
    got = {}
    for r in K.chunked(df).orderBy("session_id", "start_ordinal").collect():
        got.setdefault(r.session_id, []).append((r.start_ordinal, r.end_ordinal))
    for s in sorted({d[0] for d in data}):
        said = [{"o": d[1], "role": d[3], "content": d[4], "t": d[5]} for d in data if d[0] == s]
        assert got[s] == fold(said), s


def test_oversized_chunks(spark):
    long = "\n\n".join("p" * 1_000 for _ in range(6))
    df = spark.createDataFrame([("s", 0, 1, "human", "q" * 2_000, None), ("s", 1, 2, "assistant", long, None), ("s", 2, 3, "assistant", "tail", None)], "session_id string, ordinal long, rec_id long, role string, content string, spoken_at timestamp")
    out = K.chunked(df).orderBy("head", "part").collect()
    assert [(r.start_ordinal, r.end_ordinal) for r in out] == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 2)]
    assert all(len(r.content) // 4 <= 620 for r in out)
    assert sum(r.content.count("p") for r in out) == 6_000
    assert K.chunked(df.limit(0)).count() == 0


def test_chunk_types(spark):
    cases = [("topic", "Human: fine", "fine"), ("correction", "Human: no, not that", "not that one"), ("decision", "Assistant: we decided", ""), ("moment", "I felt sad and angry", ""), ("emotional", "felt sad" + " x" * 500, "")]
    df = spark.createDataFrame(cases, "want string, t string, h string")
    assert all(r[0] == r[1] for r in df.select("want", K.chunk_type(F.col("t"), F.col("h"))).collect())


def test_pronouns():
    text = "Intro for you\n\nHuman: I’m glad you said `I am` my way\n\nand me too\n\nAssistant: You're right, they know. ```you```"
    assert K.resolve_pronouns(text, "Ann", "Bot") == "Intro for you\n\nHuman: Ann is glad Bot said `I am` Ann's way\n\nand Ann too\n\nAssistant: Ann is right, they know. ```you```"


def test_text_functions(spark):
    assert [porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "adoption", "controlling", "generalizations")] == ["caress", "poni", "relat", "hop", "happi", "adopt", "control", "gener"]
    one = spark.range(1).select(trigram_similarity(F.lit("word"), F.lit("two words")), trigram_similarity(F.lit(""), F.lit("")), cosine_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert one[0] == pytest.approx(4 / 11) and one[1] == 0 and one[2] == 0 and one[3] is None


def test_similar_names_find_every_pair(spark, rows):
    rng = random.Random(2)
    names = {"".join(rng.choice("abc ") for _ in range(rng.randrange(3, 9))) for _ in range(150)}
    df = spark.createDataFrame([("k", n) for n in names] + [("k", None)], "kind string, name string")
    grams = lambda n: {(f"  {w} ")[i : i + 3] for w in n.split() for i in range(len(w) + 1)}
    low = sorted({n.lower() for n in names})
    want = {(a, b) for i, a in enumerate(low) for b in low[i + 1 :] if grams(a) | grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > 0.6}
    assert {(r.name_a, r.name_b) for r in similar_names(df).collect()} == want


def test_graph(spark, rows):
    edge = "edge_id long, source_id long, target_id long, relation_type string, valid_from timestamp, superseded_at timestamp"
    e = spark.createDataFrame([(1, 1, 2, "uses", None, None), (2, 2, 3, "part_of", None, None), (3, 4, 3, "uses", None, None), (4, 4, 5, "uses", None, None), (5, 5, 1, "uses", None, None), (6, 1, 1, "uses", None, None)], edge)
    root = spark.createDataFrame([(1,)], "entity_id long")
    assert rows(G.neighbourhood(e, root, 1)) == [(2, 1), (5, 1)]
    assert rows(G.neighbourhood(e, root, 10)) == rows(G.neighbourhood(e, root, 3)) == [(2, 1), (3, 2), (4, 2), (5, 1)]
    assert rows(G.neighbourhood(e, root, 3, ["part_of"])) == []
    assert rows(G.induced(e, spark.createDataFrame([(1,), (2,)], "entity_id long")), "edge_id") == [(1,), (6,)]
    closed = e.withColumn("superseded_at", F.when(F.col("edge_id") == 1, F.current_timestamp()))
    assert rows(G.neighbourhood(closed, root, 1)) == [(5, 1)]
    e = spark.createDataFrame([(1, 1, 2, "works_at", None, None)], edge).withColumn("valid_from", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([(1, 3, "works_at", "2024-02-01"), (1, 2, "works_at", None), (1, 4, "works_at", "2023-01-01"), (1, 9, "uses", None), (1, 5, "works_at", None)], "source_id long, target_id long, relation_type string, valid_from string").withColumn("valid_from", F.col("valid_from").cast("timestamp"))
    assert rows(G.supersede(e, new, ["works_at"]), "target_id", "action", "closes") == [(2, "duplicate", None), (3, "supersede", 1), (4, "skip", None), (5, "supersede", 1), (9, "create", None)]


def test_routing(spark):
    e = spark.createDataFrame([(1, "User", "Person", []), (2, "Assistant", "Person", []), (10, "Neovim", "Tool", ["nvim"]), (11, "Python", "Skill", None)], "id long, name string, entity_type string, aliases array<string>")
    denied = spark.createDataFrame([("Spam", "Tool")], "name string, entity_type string")
    cases = [("user", "Person", "new", 0.1, "singleton", 1), ("Rust", "Tool", "new", 0.9, "create_new", None), ("Rust", "Tool", "new", 0.5, "review", None), ("Rust", "Tool", "uncertain", 0.95, "review", None), ("neovim", "Tool", "existing", 0.9, "apply_existing", 10), ("Neovim", "Tool", "existing", 0.5, "review", 10), ("python", "Tool", "new", 0.9, "review", 11), ("SPAM", "Tool", "new", 0.9, "skip", None), ("spam", "Skill", "new", 0.9, "create_new", None), ("NVIM", "Tool", "existing", 0.8, "apply_existing", 10), ("Neovims", "Tool", "new", 0.9, "review", 10)]
    p = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "proposal_id long, name string, entity_type string, match string, confidence double")
    got = {r.proposal_id: (r.action, r.entity_id) for r in C.route_entities(p, e, denied).collect()}
    assert got == {i: c[4:] for i, c in enumerate(cases)}
    r = spark.createDataFrame([(1, 7, "user", "Rust"), (2, 7, "rust", "RUST"), (3, 7, "user", "Go"), (4, 8, "user", "Rust")], "relation_id long, chunk_id long, source string, target string")
    a = spark.createDataFrame([(7, "Rust", 20)], "chunk_id long, name string, entity_id long")
    assert {x.relation_id: x.action for x in C.route_relations(r, a).collect()} == {1: "apply", 2: "skip: itself", 3: "skip: unresolved", 4: "skip: unresolved"}


def test_patches(spark, rows):
    kv = spark.createDataFrame([("a", "old", 1)], "key string, content string, updated_at long")
    new = spark.createDataFrame([(" a ", " new ", 2), ("b", " ", 3), ("c", "x", 3)], "key string, content string, updated_at long")
    assert rows(C.put(kv, new)) == [("a", "new", 2), ("c", "x", 3)]
    e = spark.createDataFrame([(1, "A"), (5, "a"), (7, "B")], "id long, name string")
    assert rows(C.resolve_name(e, spark.createDataFrame([("a",), ("b ",), ("z",)], "name string"))) == [("a", None, 2), ("b ", 7, 1), ("z", None, 0)]
    assert rows(C.next_ids(spark.createDataFrame([("x",), ("y",)], "name string"), e, ["name"]), "id", "name") == [(8, "x"), (9, "y")]
    patch = spark.createDataFrame([(5, None), (7, "C")], "id long, name string")
    assert rows(C.corrected(e, patch, "id", ["name"])) == [(1, "A"), (5, "a"), (7, "C")]
    d = spark.createDataFrame([("foo", "Tool"), ("bar", "Tool")], "name string, entity_type string")
    assert rows(C.without_denial(d, " FOO", "Tool")) == [("bar", "Tool")]


def test_sources(spark, rows, tmp_path):
    (tmp_path / "p" / "subagents").mkdir(parents=True)
    lines = [{"type": "user", "uuid": "1", "sessionId": "S", "message": {"role": "user", "content": "hello \x00world " + "long " * 30}}, {"type": "assistant", "uuid": "2", "parentUuid": "1", "timestamp": "2026-03-20T08:00:00.086Z", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "?"}, {"type": "text", "text": " hi "}]}}, {"type": "user", "uuid": "3", "parentUuid": "2", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "r"}]}}]
    (tmp_path / "p" / "one.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    (tmp_path / "p" / "two.jsonl").write_text(json.dumps({"type": "user", "uuid": "9", "message": {"role": "user", "content": "x"}}))
    (tmp_path / "p" / "subagents" / "no.jsonl").write_text(json.dumps(lines[0]))
    log = R.parsed_log(R.session_log_lines(spark, str(tmp_path)))
    assert rows(log, "sessionId", "uuid") == [("S", "1"), ("S", "2"), ("S", "3"), ("two", "9")]
    from lorebase.functions.messages import with_identifiers

    said = R.messages(with_identifiers(log.withColumn("rec_id", F.col("line_no").cast("long"))))
    assert rows(said.filter("session_id = 's'"), "ordinal", "role", F.substring("content", 1, 11)) == [(0, "human", "hello world"), (1, "assistant", "hi")]
    names = dict(R.conversation_names(said).collect())
    assert names["s"].endswith("long...") and len(names["s"]) <= 80 and names["two"] == "x"

    (tmp_path / "a.json").write_text(json.dumps([{"uuid": "u", "name": "n", "created_at": "2026-01-01T00:00:00Z", "messages": [{"role": "user", "text": "q"}, {"role": "tool", "text": "z"}, {"role": "assistant", "text": "a"}]}, {"name": "no id", "messages": []}]))
    assert rows(R.archive_messages(spark, str(tmp_path / "a.json")), "session_id", "ordinal", "role", "content") == [("u", 0, "human", "q"), ("u", 1, "assistant", "a")]

    (tmp_path / "result_1.json").write_text(json.dumps({"conversation_id": 4, "chunks": [{"chunk_id": 1, "entities": [{"name": "A", "entity_type": "Tool", "match": "new", "confidence": 1}]}, {"entities": []}]}))
    (tmp_path / "result_2.json").write_text("{")
    results = R.extraction_results(spark, str(tmp_path))
    assert rows(results, "chunk_id", "error") == [(1, None), (None, "chunk_id is missing"), (None, "unreadable")]
    mine, other = R.owned(results.filter("error IS NULL"), spark.createDataFrame([(1, 5)], "id long, conversation_id long"))
    assert (mine.count(), other.count()) == (0, 1)

    (tmp_path / "voice.md").write_text("  calm \n")
    (tmp_path / "empty.md").write_text(" ")
    assert rows(R.notes(spark, str(tmp_path))) == [("voice", "calm")]

    good, bad = R.direct_messages(spark.createDataFrame([("s", "human", "c", 0, "2026-01-01T00:00:00Z"), ("s", "robot", "c", 1, None), ("s", "human", "c", 2, "soon")], "session_id string, role string, content string, ordinal long, spoken_at string"))
    assert good.count() == 1 and rows(bad, "error") == [("role",), ("spoken_at",)]

    chunks = spark.createDataFrame([(1, 7, "x", "topic", 3, 0), (2, 7, "y", "topic", 3, 4)], "id long, conversation_id long, raw_content string, chunk_type string, significance int, start_ordinal int")
    R.export_chunks(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    broken = R.violations(chunks, "chunks", unique=[["id"], ["conversation_id"]], required=["raw_content"], allowed={"significance": [1, 2]}, foreign={"conversation_id": (chunks, "id")})
    assert {r.rule: r.n for r in broken.collect()} == {"raw_content is null": 0, "significance is not allowed": 2, "id repeated": 0, "conversation_id repeated": 1, "conversation_id has no match": 2}


def test_streaming_state(spark, tmp_path):
    from lorebase.streaming import ingest as S

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "2026-01-01 00:00:00", 5), (2, "2026-01-01 00:10:00", 5), (3, "2026-01-02 00:00:00", 6)], "event_id long, ts string, user_id long").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema(S.EVENTS).parquet(str(tmp_path / "in" / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = []
    S.land_batches(S.running_totals(stream), lambda df, _: seen.extend(tuple(r) for r in df.select("user_id", "n").collect()), str(tmp_path / "state"), "update")
    assert dict(seen) == {5: 2, 6: 1}


def test_embedding(spark, rows):
    from lorebase.operators.embedding import embedded, hashing_provider, reembedded, with_neighbours

    df = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"word {i}") for i in range(250)], "k long, t string")
    got = {r.k: r.embedding for r in embedded(df, "k", "t", hashing_provider(8)).collect()}
    assert len(got) == 250 and got[3] is None and got[4] is None and len(got[5]) == 8

    def failing(texts):
        raise OSError("no service")

    broken = embedded(df.filter("k < 5"), "k", "t", failing, delay=0.01).collect()
    assert {r.embedding for r in broken} == {None} and {(r.k, r.error) for r in broken} == {(k, "OSError: no service" if k < 3 else None) for k in range(5)}

    def wrong(texts):
        raise ValueError("bad text")

    began = time.monotonic()
    assert embedded(df.filter("k < 2"), "k", "t", wrong, delay=60.0).filter("error = 'ValueError: bad text'").count() == 2 and time.monotonic() - began < 50
    chunks = spark.createDataFrame([(1, 10, "a b", [9.0]), (2, 10, None, None), (3, 11, "", [1.0]), (4, 12, "c", None)], "id long, conversation_id long, raw_content string, embedding array<float>")
    again, outcome = reembedded(chunks, hashing_provider(8))
    assert {r.id: r.embedding and len(r.embedding) for r in again.collect()} == {1: 8, 2: None, 3: None, 4: 8}
    assert rows(outcome, "conversation_id", "outcome") == [(10, "embedded"), (11, "empty"), (12, "embedded")]
    assert rows(reembedded(chunks, failing, delay=0.01)[1], "conversation_id", "outcome") == [(10, "failed"), (11, "empty"), (12, "failed")]
    assert [len(hashing_provider(8)(["a b"])[0]), hashing_provider(8)([" "])] == [8, [None]]
    near = with_neighbours(df.filter("k < 3").withColumn("g", F.lit("g")), "g", "k", ["t"])
    assert rows(near, "k", "prev_t", "next_t") == [(0, None, "word 1"), (1, "word 0", "word 2"), (2, "word 1", None)]


@pytest.mark.parametrize("task_rows", [2_000_000, 2])
def test_reply_order(spark, task_rows):
    """The walk of linearised() against a plain one: late parents, siblings by time, sidechains, loops, copies."""
    from lorebase.functions.messages import with_identifiers

    said = json.dumps({"content": "x"})
    hour = lambda h: f"2026-01-01T{h:02}:00:00Z"
    data = [
        (1, "s", "reply", "start", "assistant", None, said, hour(2)),
        (2, "s", "start", None, "user", None, said, hour(1)),
        (3, "s", "later", "start", "assistant", None, said, hour(4)),
        (4, "s", "under", "reply", "user", None, said, hour(9)),
        (5, "s", "unknown", "start", "assistant", None, said, None),
        (6, "s", "side", "start", "assistant", True, said, hour(1)),
        (7, "s", "below", "side", "user", None, said, hour(1)),
        (8, "s", "tool", "later", "user", None, json.dumps({"content": [{"type": "tool_result"}]}), hour(5)),
        (9, "s", "anew", "tool", "assistant", None, said, hour(0)),
        (10, "s", " REPLY", None, "assistant", None, said, hour(0)),
        (11, "s", None, "start", "user", None, said, hour(1)),
        (12, "s", "hang", "b", "user", None, said, hour(1)),
        (13, "s", "a", "b", "user", None, said, hour(1)),
        (14, "s", "b", "a", "assistant", None, said, hour(1)),
        (15, "s", "hollow", "anew", "assistant", None, json.dumps({"content": " "}), hour(1)),
        (16, "s", "through", "hollow", "user", None, said, hour(1)),
        (17, "t", "reply", "start", "user", None, said, hour(1)),
    ]
    df = with_identifiers(spark.createDataFrame(data, "rec_id long, sessionId string, uuid string, parentUuid string, type string, isSidechain boolean, message string, timestamp string"))
    got = [(r.session_id, r.ordinal, r.rec_id) for r in R.linearised(df, task_rows).orderBy("session_id", "ordinal").collect()]
    assert got == [("s", i, r) for i, r in enumerate([2, 5, 1, 4, 3, 9, 16, 11, 13, 14, 12])] + [("t", 0, 17)]
    assert R.linearised(df.limit(0), task_rows).count() == 0
