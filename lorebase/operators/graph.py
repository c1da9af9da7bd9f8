"""Graph traversal over an edge table (edge_id, source_id, target_id, relation_type, superseded_at)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import cut, exchanged

MAX_HOPS = 3


def active(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("superseded_at").isNull())


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, so that one equi join finds the neighbours on either side."""
    return edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int = MAX_HOPS, types: Sequence[str] | None = None) -> DataFrame:
    """(entity_id, depth): entities at most hops (clamped to 1..3) active edges from roots(entity_id), without the roots.

    Breadth first: each hop is one join of the frontier and one anti-join with what was seen. The steps are made once.
    """
    used = active(edges)
    if types is not None:
        used = used.filter(F.col("relation_type").isin(list(types)))
    steps = cut(undirected(used))
    seen = roots.select("entity_id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max(1, min(MAX_HOPS, hops)) + 1):
        met = steps.join(frontier.select(F.col("entity_id").alias("a")), "a").select(F.col("b").alias("entity_id")).distinct()
        frontier = cut(met.join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges with both ends among nodes(entity_id)."""
    ids = nodes.select("entity_id").distinct()
    inside = active(edges).join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    return inside.join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")


def profile(edges: DataFrame, names: DataFrame, entity: int) -> DataFrame:
    """Edges of one entity with direction (a loop counts as outbound) and the other end's name."""
    own = active(edges).filter((F.col("source_id") == entity) | (F.col("target_id") == entity))
    out = F.col("source_id") == entity
    own = own.select("edge_id", F.when(out, "outbound").otherwise("inbound").alias("direction"), "relation_type", F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"))
    return own.join(names.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id")


def superseded(facts: DataFrame, key: Sequence[str], valid_from: str, tie: str, days: int = 31) -> DataFrame:
    """Timeline of exclusive facts: each is closed by the next one of its key (superseded_at, superseded_by).

    Facts are ordered inside stretches of days, and the last one of a stretch is closed by the first of the next, so a
    key with a third of all facts is spread over many tasks. Facts without a date come first.
    """
    placed = facts.withColumn("__cut", F.floor(F.unix_seconds(F.col(valid_from).cast("timestamp")) / (86_400 * days)))
    order = Window.partitionBy(*key, "__cut").orderBy(valid_from, tie)
    one = F.struct(F.col(valid_from).alias("at"), F.col(tie).alias("by"))
    heads = placed.groupBy(*key, "__cut").agg(F.min_by(one, F.struct(valid_from, tie)).alias("__first"))
    after = heads.withColumn("__after", F.lead("__first").over(Window.partitionBy(*key).orderBy(F.col("__cut").asc_nulls_first()))).drop("__first")
    names = [*key, "__cut"]
    right = after.select(*(F.col(c).alias(f"__r_{c}") for c in names), "__after")
    met = placed.withColumn("__next", F.lead(one).over(order)).join(exchanged(right), [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names])
    closed = met.withColumn("__next", F.coalesce("__next", "__after"))
    return closed.withColumns({"superseded_at": F.col("__next.at"), "superseded_by": F.col("__next.by")}).drop("__next", "__after", "__cut", *(f"__r_{c}" for c in names))


def supersede(edges: DataFrame, incoming: DataFrame, exclusive: Sequence[str]) -> DataFrame:
    """incoming relations with action: duplicate (active already), skip, supersede (with closes) or create.

    An exclusive relation to another target closes the active one, unless both are dated and it is not newer.
    """
    now = active(edges).select("source_id", "relation_type", F.col("target_id").alias("old_target"), F.col("edge_id").alias("old_edge"), F.col("valid_from").alias("old_from"))
    same = now.select("source_id", "relation_type", F.col("old_target").alias("target_id"), F.lit(True).alias("same")).distinct()
    rival = now.filter(F.col("relation_type").isin(list(exclusive))).groupBy("source_id", "relation_type").agg(F.max_by(F.struct("old_target", "old_edge", "old_from"), F.struct("old_from", "old_edge")).alias("old"))
    out = incoming.join(exchanged(same), ["source_id", "relation_type", "target_id"], "left").join(exchanged(rival), ["source_id", "relation_type"], "left")
    stale = F.col("valid_from").isNotNull() & F.col("old.old_from").isNotNull() & (F.col("valid_from") <= F.col("old.old_from"))
    action = F.when(F.col("same"), "duplicate").when(F.col("old").isNull(), "create").when(stale, "skip").otherwise("supersede")
    return out.withColumn("action", action).withColumn("closes", F.when(F.col("action") == "supersede", F.col("old.old_edge"))).drop("same", "old")
