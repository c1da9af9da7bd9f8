"""Queries over a knowledge graph and its audits, with their SQL.

The graph is read off the relational tables: nations are part of regions, customers live in nations and use the parts they
ordered. Ids are offset by kind, so they never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators import audits as A
from lorebase.operators import graph as G
from lorebase.operators.curation import merged_aliases, merged_edges, merged_links, type_votes
from lorebase.sources.tables import table

AS_OF = "2026-06-01 00:00:00"
REGION, NATION, CUSTOMER, PART = 0, 1_000, 10_000_000_000, 20_000_000_000
NATION_EDGE, CUSTOMER_EDGE, PART_EDGE = 0, 1_000_000, 10_000_000_000
ROOT = CUSTOMER + 1


def nodes(spark: SparkSession, root: str) -> DataFrame:
    kinds = [("region", "r_regionkey", "r_name", REGION, "Place"), ("nation", "n_nationkey", "n_name", NATION, "Place"), ("customer", "c_custkey", "c_name", CUSTOMER, "Person"), ("part", "p_partkey", "p_name", PART, "Tool")]
    parts = [table(spark, root, t).select((F.col(k).cast("long") + off).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("entity_type")) for t, k, n, off, kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(spark: SparkSession, root: str) -> DataFrame:
    """edge_id, source_id, target_id, relation_type, valid_from, superseded_at; orders older than 1996 count as superseded."""
    never = F.lit(None).cast("timestamp_ntz")
    within = table(spark, root, "nation").select((F.col("n_nationkey").cast("long") + NATION_EDGE).alias("edge_id"), (F.col("n_nationkey").cast("long") + NATION).alias("source_id"), (F.col("n_regionkey").cast("long") + REGION).alias("target_id"), F.lit("part_of").alias("relation_type"), never.alias("valid_from"), never.alias("superseded_at"))
    lives = table(spark, root, "customer").select((F.col("c_custkey") + CUSTOMER_EDGE).alias("edge_id"), (F.col("c_custkey") + CUSTOMER).alias("source_id"), (F.col("c_nationkey").cast("long") + NATION).alias("target_id"), F.lit("lives_in").alias("relation_type"), never.alias("valid_from"), never.alias("superseded_at"))
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    uses = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select((F.col("o_orderkey") * 8 + F.col("l_linenumber") + PART_EDGE).alias("edge_id"), (F.col("o_custkey") + CUSTOMER).alias("source_id"), (F.col("l_partkey") + PART).alias("target_id"), F.lit("uses").alias("relation_type"), F.col("d").alias("valid_from"), F.when(F.col("d") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("d")).alias("superseded_at"))
    return within.unionByName(lives).unionByName(uses)


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ROOT,)], "entity_id long")


def neighbourhood_bfs(spark: SparkSession, root: str) -> DataFrame:
    return G.neighbourhood(edges(spark, root), _root(spark), 3).withColumn("depth", F.col("depth").cast("long"))


def neighbourhood_typed(spark: SparkSession, root: str) -> DataFrame:
    return G.neighbourhood(edges(spark, root), _root(spark), 3, ["lives_in", "part_of"]).withColumn("depth", F.col("depth").cast("long"))


def induced_subgraph(spark: SparkSession, root: str) -> DataFrame:
    near = G.neighbourhood(edges(spark, root), _root(spark), 2).select("entity_id").union(_root(spark))
    return G.induced(edges(spark, root), near).select("edge_id", "source_id", "target_id")


def depth_totals(spark: SparkSession, root: str) -> DataFrame:
    return neighbourhood_bfs(spark, root).groupBy("depth").agg(F.count("*").alias("n"))


def entity_profile(spark: SparkSession, root: str) -> DataFrame:
    return G.profile(edges(spark, root), nodes(spark, root), ROOT).select("edge_id", "direction", "other_name", "relation_type")


def supersession_timeline(spark: SparkSession, root: str) -> DataFrame:
    """Each customer's order status as an exclusive fact that the next order closes."""
    facts = table(spark, root, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"))
    return G.superseded(facts, ["o_custkey"], "valid_from", "o_orderkey").select("o_custkey", "o_orderkey", "valid_from", "superseded_at")


def audit_duplicate_entities(spark: SparkSession, root: str) -> DataFrame:
    """The fifty most similar pairs of names of one type."""
    found = A.similar_names(table(spark, root, "entities").select(F.col("entity_type").alias("kind"), "name"))
    return found.orderBy(F.col("similarity").desc(), "kind", "name_a", "name_b").limit(50).select("kind", "name_a", "name_b", F.round("similarity", 6).alias("similarity"))


def similar_entity_names(spark: SparkSession, root: str) -> DataFrame:
    """All such pairs."""
    found = A.similar_names(table(spark, root, "entities").select(F.col("entity_type").alias("kind"), "name"))
    return found.withColumn("similarity", F.round("similarity", 6))


def audit_orphans(spark: SparkSession, root: str) -> DataFrame:
    return A.orphans(table(spark, root, "entities"), table(spark, root, "entity_chunks")).select("id", "name")


def audit_broken_relations(spark: SparkSession, root: str) -> DataFrame:
    """Edges whose parts above size 40 were taken out of the graph."""
    small = table(spark, root, "part").filter("p_size <= 40").select((F.col("p_partkey") + PART).alias("id"))
    left = nodes(spark, root).filter("entity_type <> 'Tool'").select("id").union(small)
    return A.broken_relations(edges(spark, root), left)


def audit_duplicate_relations(spark: SparkSession, root: str) -> DataFrame:
    found = A.repeated(G.active(edges(spark, root)), ["source_id", "target_id", "relation_type"], "edge_id", ["edge_id"])
    return found.select("source_id", "target_id", "relation_type", "cnt", F.array_join("ids", ",").alias("edges"))


def audit_stale(spark: SparkSession, root: str) -> DataFrame:
    return A.stale(table(spark, root, "entities"), AS_OF).select("id", "name", F.col("access_count").cast("long"))


def entity_type_votes(spark: SparkSession, root: str) -> DataFrame:
    live = edges(spark, root)
    return type_votes(nodes(spark, root), live).withColumn("confidence", F.round("confidence", 6))


def _merges(spark: SparkSession, root: str) -> DataFrame:
    """Entities whose id ends in 7 are merged into the one whose id ends in 0 before them."""
    return table(spark, root, "entities").filter("id % 10 = 7 AND id > 10").select(F.col("id").alias("source_id"), (F.col("id") - 7).alias("target_id"))


def merge_entity_aliases(spark: SparkSession, root: str) -> DataFrame:
    return merged_aliases(table(spark, root, "entities"), _merges(spark, root)).select("id", F.array_join("aliases", "|").alias("aliases"))


def merge_entity_links(spark: SparkSession, root: str) -> DataFrame:
    return merged_links(table(spark, root, "entity_chunks"), _merges(spark, root))


def merge_entity_edges(spark: SparkSession, root: str) -> DataFrame:
    """Customers with odd keys merged into the even one after them."""
    merges = table(spark, root, "customer").filter("c_custkey % 2 = 1").select((F.col("c_custkey") + CUSTOMER).alias("source_id"), (F.col("c_custkey") + 1 + CUSTOMER).alias("target_id"))
    return merged_edges(edges(spark, root), merges).select("edge_id", "source_id", "target_id")


QUERIES = {
    f.__name__: f
    for f in (
        neighbourhood_bfs, neighbourhood_typed, induced_subgraph, depth_totals, entity_profile, supersession_timeline, audit_duplicate_entities, similar_entity_names, audit_orphans,
        audit_broken_relations, audit_duplicate_relations, audit_stale, entity_type_votes, merge_entity_aliases, merge_entity_links, merge_entity_edges,
    )
}

EDGES = f"""nodes AS (SELECT r_regionkey::BIGINT AS id, r_name AS name, 'Place' AS entity_type FROM region UNION ALL SELECT n_nationkey + {NATION}, n_name, 'Place' FROM nation
UNION ALL SELECT c_custkey + {CUSTOMER}, c_name, 'Person' FROM customer UNION ALL SELECT p_partkey + {PART}, p_name, 'Tool' FROM part),
every AS (SELECT n_nationkey::BIGINT AS edge_id, n_nationkey + {NATION}::BIGINT AS source_id, n_regionkey::BIGINT AS target_id, 'part_of' AS relation_type, NULL::TIMESTAMP AS superseded_at FROM nation
UNION ALL SELECT c_custkey + {CUSTOMER_EDGE}, c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'lives_in', NULL FROM customer
UNION ALL SELECT o_orderkey * 8 + l_linenumber + {PART_EDGE}, o_custkey + {CUSTOMER}, l_partkey + {PART}, 'uses', CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN o_orderdate END FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
live AS (SELECT * FROM every WHERE superseded_at IS NULL)"""


def _bfs(types: str = "TRUE", hops: int = 3) -> str:
    return f"""WITH RECURSIVE {EDGES}, ways AS (SELECT source_id AS a, target_id AS b FROM live WHERE {types} UNION SELECT target_id, source_id FROM live WHERE {types}),
walk AS (SELECT {ROOT}::BIGINT AS entity_id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN ways ON a = entity_id WHERE depth < {hops}),
near AS (SELECT entity_id, min(depth)::BIGINT AS depth FROM walk GROUP BY 1)"""


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({n}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2]))))"
_SIMILAR = f"""WITH g AS (SELECT DISTINCT entity_type AS kind, lower(name) AS name, {_GRAMS.format(n='name')} AS t FROM entities WHERE name IS NOT NULL),
p AS (SELECT a.kind, a.name AS name_a, b.name AS name_b, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) AS s FROM g a JOIN g b ON a.kind = b.kind AND a.name < b.name)
SELECT kind, name_a, name_b, round(s, 6) AS similarity FROM p WHERE s > 0.6"""

SQL = {
    "neighbourhood_bfs": _bfs() + " SELECT * FROM near WHERE depth > 0",
    "neighbourhood_typed": _bfs("relation_type IN ('lives_in', 'part_of')") + " SELECT * FROM near WHERE depth > 0",
    "induced_subgraph": _bfs(hops=2) + " SELECT edge_id, source_id, target_id FROM live WHERE source_id IN (SELECT entity_id FROM near) AND target_id IN (SELECT entity_id FROM near)",
    "depth_totals": _bfs() + " SELECT depth, count(*) AS n FROM near WHERE depth > 0 GROUP BY 1",
    "entity_profile": f"WITH {EDGES} SELECT edge_id, CASE WHEN source_id = {ROOT} THEN 'outbound' ELSE 'inbound' END AS direction, name AS other_name, relation_type FROM live JOIN nodes ON id = CASE WHEN source_id = {ROOT} THEN target_id ELSE source_id END WHERE source_id = {ROOT} OR target_id = {ROOT}",
    "supersession_timeline": "SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_at FROM orders",
    "audit_duplicate_entities": _SIMILAR + " ORDER BY s DESC, kind, name_a, name_b LIMIT 50",
    "similar_entity_names": _SIMILAR,
    "audit_orphans": "SELECT id, name FROM entities WHERE id NOT IN (1, 2) AND id NOT IN (SELECT entity_id FROM entity_chunks)",
    "audit_broken_relations": f"WITH {EDGES}, ids AS (SELECT id FROM nodes WHERE entity_type <> 'Tool' UNION ALL SELECT p_partkey + {PART} FROM part WHERE p_size <= 40) SELECT edge_id, 'source' AS side FROM live WHERE source_id NOT IN (SELECT id FROM ids) UNION ALL SELECT edge_id, 'target' FROM live WHERE target_id NOT IN (SELECT id FROM ids)",
    "audit_duplicate_relations": f"WITH {EDGES} SELECT source_id, target_id, relation_type, count(*) AS cnt, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS edges FROM live GROUP BY ALL HAVING count(*) > 1",
    "audit_stale": f"SELECT id, name, access_count::BIGINT AS access_count FROM entities WHERE id NOT IN (1, 2) AND (last_accessed_at IS NULL OR last_accessed_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 90 DAYS) AND coalesce(access_count, 0) < 3",
    "entity_type_votes": f"""WITH {EDGES}, hint AS (SELECT * FROM (VALUES ('lives_in', 'Person', 'Place'), ('uses', 'Person', 'Tool'), ('part_of', 'Infrastructure', NULL)) t(relation_type, s, t)),
v AS (SELECT source_id AS id, s AS type, 1 AS w FROM live JOIN hint USING (relation_type) UNION ALL SELECT target_id, t, 1 FROM live JOIN hint USING (relation_type)),
m AS (SELECT id, type, sum(w) AS w FROM v WHERE type IS NOT NULL GROUP BY ALL), top AS (SELECT id, type, w / sum(w) OVER (PARTITION BY id) AS c FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, type) = 1)
SELECT n.id AS entity_id, entity_type AS current_type, CASE WHEN type <> entity_type THEN type END AS suggested_type, round(coalesce(c, 1), 6) AS confidence FROM nodes n LEFT JOIN top USING (id)""",
    "merge_entity_aliases": "WITH m AS (SELECT id AS s, id - 7 AS t FROM entities WHERE id % 10 = 7 AND id > 10) SELECT e.id, array_to_string(list_filter(list_transform(a, lambda x, i: CASE WHEN list_position(a, x) = i THEN x END), lambda x: x IS NOT NULL), '|') AS aliases FROM (SELECT e.id, coalesce(e.aliases, []) || [x.name] || coalesce(x.aliases, []) AS a FROM entities e JOIN m ON m.t = e.id JOIN entities x ON x.id = m.s) e",
    "merge_entity_links": "SELECT DISTINCT CASE WHEN entity_id % 10 = 7 AND entity_id > 10 AND entity_id IN (SELECT id FROM entities) THEN entity_id - 7 ELSE entity_id END AS entity_id, chunk_id FROM entity_chunks",
    "merge_entity_edges": f"""WITH {EDGES}, r AS (SELECT edge_id, CASE WHEN source_id IN (SELECT c_custkey + {CUSTOMER} FROM customer WHERE c_custkey % 2 = 1) THEN source_id + 1 ELSE source_id END AS source_id, target_id, relation_type, superseded_at FROM every)
SELECT edge_id, source_id, target_id FROM r WHERE source_id <> target_id QUALIFY superseded_at IS NOT NULL OR row_number() OVER (PARTITION BY source_id, target_id, relation_type, superseded_at ORDER BY edge_id) = 1""",
}
