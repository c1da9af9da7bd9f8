"""Extraction results linked into the graph, and what people decide about the doubtful ones.

Everything is set-based on one snapshot of the tables: an action for every proposal and relation, then the rows each
action adds or changes. Tables are rewritten from these rows (append-only logs, latest views), never updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import vocabulary as V
from lorebase.operators.curation import entity_errors, next_ids, relation_errors, route_entities, route_relations
from lorebase.operators.graph import supersede, superseded
from lorebase.session import cut, exchanged

COUNTERS = ("entities_applied", "entities_created", "entities_reviewed", "entities_rejected", "relations_created", "relations_superseded", "relations_skipped", "flags")


@dataclass(frozen=True)
class Linked:
    """actions: proposal_id, chunk_id, name, entity_type, action, entity_id, reason, candidates, summary, reasoning.
    entities: new rows (id, name, entity_type, summary). summaries: (id, summary) of existing ones. links: (entity_id,
    chunk_id). relations: relation_id, chunk_id, source_id, target_id, relation_type, outcome, closes. edges: new rows;
    closed: (edge_id, superseded_by). edge_links: (edge_id, chunk_id). counters: chunk_id and COUNTERS."""

    actions: DataFrame
    entities: DataFrame
    summaries: DataFrame
    links: DataFrame
    relations: DataFrame
    edges: DataFrame
    closed: DataFrame
    edge_links: DataFrame
    counters: DataFrame


def linked(proposals: DataFrame, relations: DataFrame, entities: DataFrame, denied: DataFrame, edges: DataFrame, flags: DataFrame | None = None, exclusive: Sequence[str] = V.EXCLUSIVE_RELATIONS) -> Linked:
    """What the extraction results change.

    proposals: proposal_id (unique), chunk_id, name, entity_type, match, confidence, summary, reasoning. relations:
    relation_id (unique), chunk_id, source, target, relation_type, description, valid_from. edges: edge_id, source_id,
    target_id, relation_type, valid_from, superseded_at. flags: chunk_id, one row a flag. Invalid rows are rejected and
    counted; equal new names become one entity; equal new relations one edge, the later ones only link their chunk; new
    exclusive relations of one source close each other in order of date and relation_id.
    """
    checked = proposals.withColumn("__bad", F.size(entity_errors()) > 0)
    routed = route_entities(checked.filter("NOT __bad"), entities, denied).select("proposal_id", "action", "entity_id", "reason", "candidates")
    acted = cut(proposals.join(exchanged(routed), "proposal_id", "left").withColumn("action", F.coalesce("action", F.lit("reject"))))
    fresh = acted.filter("action = 'create_new'").groupBy(F.trim("name").alias("name"), "entity_type").agg(F.max("summary").alias("summary"))
    made = cut(next_ids(fresh, entities, ["name", "entity_type"]).select("id", "name", "entity_type", "summary"))
    new_id = made.select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("entity_type").alias("__type"))
    named = acted.join(exchanged(new_id), (F.trim("name") == F.col("__name")) & (F.col("entity_type") == F.col("__type")) & (F.col("action") == "create_new"), "left")
    actions = cut(named.withColumn("entity_id", F.coalesce("__id", "entity_id")).drop("__id", "__name", "__type"))
    applied = actions.filter(F.col("action").isin("singleton", "apply_existing", "create_new"))
    told = applied.filter("action = 'apply_existing' AND summary <> ''").groupBy(F.col("entity_id").alias("id")).agg(F.max_by("summary", "proposal_id").alias("summary"))

    sound = relations.withColumn("__bad", F.size(relation_errors()) > 0)
    ends = route_relations(sound.filter("NOT __bad").drop("__bad"), applied.select("chunk_id", "name", "entity_id"))
    met = ends.filter("action = 'apply'").select("relation_id", "chunk_id", "source_id", "target_id", "relation_type", "description", "valid_from")
    judged = cut(supersede(edges, met, exclusive))
    open_ = judged.filter(F.col("action").isin("create", "supersede"))
    same = ["source_id", "target_id", "relation_type"]
    first = open_.groupBy(*same).agg(F.min("relation_id").alias("first"))
    open_ = open_.join(exchanged(first), same)
    heads = next_ids(open_.filter("relation_id = first"), edges, ["relation_id"], "edge_id")
    # exclusive ones form a timeline per source and type; the first of it closes what was active before
    limited = F.col("relation_type").isin(list(exclusive))
    timeline = superseded(heads.filter(limited), ["source_id", "relation_type"], "valid_from", "edge_id").withColumnRenamed("superseded_by", "next_edge")
    started = timeline.groupBy("source_id", "relation_type").agg(F.min_by("edge_id", F.struct("valid_from", "edge_id")).alias("__head"))
    heads = heads.join(exchanged(timeline.select("edge_id", "next_edge")), "edge_id", "left").join(exchanged(started), ["source_id", "relation_type"], "left")
    heads = cut(heads.withColumn("closes", F.when(F.col("edge_id") == F.coalesce("__head", "edge_id"), F.col("closes"))))
    rival = limited & (F.col("edge_id") != F.coalesce("__head", "edge_id"))
    outcome = heads.select("relation_id", F.when((F.col("action") == "supersede") | rival, "superseded").otherwise("created").alias("__o"))
    placed = relations.select("relation_id", "chunk_id", "relation_type").join(exchanged(judged.select("relation_id", "source_id", "target_id", "closes")), "relation_id", "left").join(exchanged(outcome), "relation_id", "left")
    placed = placed.withColumn("outcome", F.coalesce("__o", F.lit("skipped"))).drop("__o")
    rows = heads.select("edge_id", *same, "description", "valid_from", "next_edge")
    closed = heads.filter("closes IS NOT NULL").select(F.col("closes").alias("edge_id"), F.col("edge_id").alias("superseded_by"))
    known = edges.filter("superseded_at IS NULL").groupBy(*same).agg(F.min("edge_id").alias("edge_id"))
    of = judged.filter("action = 'duplicate'").join(exchanged(known), same).select("edge_id", "chunk_id")
    of = of.unionByName(open_.join(exchanged(heads.select(*same, "edge_id")), same).select("edge_id", "chunk_id")).distinct()

    count = lambda c: F.count_if(c).cast("long")
    act, out = F.col("action"), F.col("outcome")
    one = actions.groupBy("chunk_id").agg(count(act.isin("singleton", "apply_existing")).alias("entities_applied"), count(act == "create_new").alias("entities_created"), count(act == "review").alias("entities_reviewed"), count(act.isin("skip", "reject")).alias("entities_rejected"))
    two = placed.groupBy("chunk_id").agg(*(count(out == o).alias(f"relations_{o}") for o in ("created", "superseded", "skipped")))
    parts = [_widened(one), _widened(two)]
    if flags is not None:
        parts.append(_widened(flags.groupBy("chunk_id").agg(F.count("*").alias("flags"))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    counters = every.groupBy("chunk_id").agg(*(F.sum(c).alias(c) for c in COUNTERS))
    return Linked(actions, made, told, applied.select("entity_id", "chunk_id").distinct(), placed, rows, closed, of, counters)


def _widened(counts: DataFrame) -> DataFrame:
    return counts.select("chunk_id", *((F.col(c) if c in counts.columns else F.lit(0).cast("long")).alias(c) for c in COUNTERS))


def rolled_up(counters: DataFrame, chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counters summed per conversation, with chunks and failed chunks (failed: chunk_id, error)."""
    own = chunks.select(F.col("id").alias("chunk_id"), "conversation_id")
    bad = failed.select("chunk_id", F.lit(1).alias("__bad")).distinct() if failed is not None else own.select("chunk_id", F.lit(1).alias("__bad")).limit(0)
    met = own.join(counters, "chunk_id", "left").join(bad, "chunk_id", "left").filter(F.col("flags").isNotNull() | F.col("__bad").isNotNull())
    return met.groupBy("conversation_id").agg(F.count("*").alias("chunks"), F.count("__bad").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def queued(actions: DataFrame, queue: DataFrame, at: str) -> DataFrame:
    """New rows of the review queue for the doubtful proposals: one per chunk and name that is not pending already."""
    asked = actions.filter("action = 'review'").select("chunk_id", "name", "entity_type", "summary", "reasoning", "candidates", "reason", "proposal_id")
    once = asked.groupBy("chunk_id", "name").agg(F.min_by(F.struct("entity_type", "summary", "reasoning", "candidates", "reason", "proposal_id"), "proposal_id").alias("x")).select("chunk_id", "name", "x.*")
    waiting = queue.filter("status = 'pending'").select("chunk_id", "name").distinct()
    fresh = next_ids(once.join(waiting, ["chunk_id", "name"], "left_anti"), queue, ["proposal_id"]).drop("proposal_id")
    return fresh.withColumns({"status": F.lit("pending"), "created_at": F.lit(at).cast("timestamp")})


def review_page(queue: DataFrame, chunks: DataFrame, conversations: DataFrame, status: str = "pending", limit: int = 10) -> DataFrame:
    """The oldest rows of the queue with their chunk and conversation; limit is clamped to 1..50."""
    talk = conversations.select(F.col("id").alias("conversation_id"), F.col("name").alias("conversation_name"))
    own = chunks.select(F.col("id").alias("chunk_id"), "conversation_id", F.col("raw_content").alias("chunk_content"), "chunk_type", "significance")
    page = queue.filter(F.col("status") == status).join(own, "chunk_id").join(talk, "conversation_id")
    return page.orderBy("created_at", "id").limit(max(1, min(50, limit)))


@dataclass(frozen=True)
class Reviewed:
    """queue: all rows with their new status, resolved_entity_id and rejected candidates. entities: all rows with new
    aliases, and the new ones. links, examples (entity_name, resolved_to_id, context), denials and errors: rows to add."""

    queue: DataFrame
    entities: DataFrame
    links: DataFrame
    examples: DataFrame
    denials: DataFrame
    errors: DataFrame


def reviewed(queue: DataFrame, decisions: DataFrame, entities: DataFrame) -> Reviewed:
    """The decisions (review_id, decided_at, verdict existing, new or dismiss, entity_id, name, entity_type, summary) carried out.

    The first decision of a review counts. One about a review that is missing or not pending, or for an entity that is
    missing, is an error and changes nothing.
    """
    first = decisions.groupBy("review_id").agg(F.min_by(F.struct("verdict", "entity_id", "name", "entity_type", "summary"), F.struct("decided_at", "verdict")).alias("d")).select("review_id", "d.*")
    row = queue.select(F.col("id").alias("review_id"), "status", "chunk_id", F.col("name").alias("said"), F.col("entity_type").alias("said_type"), "reasoning", "candidates")
    known = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("known_name"))
    met = first.join(row, "review_id", "left").join(known, "entity_id", "left")
    error = (
        F.when(F.col("status").isNull(), "review not found").when(F.col("status") != "pending", F.concat(F.lit("review is already "), "status"))
        .when((F.col("verdict") == "existing") & F.col("known_name").isNull(), "entity not found").when((F.col("verdict") == "new") & (F.coalesce(F.trim("name"), F.lit("")) == ""), "name is missing")
    )
    met = cut(met.withColumn("error", error))
    good = met.filter("error IS NULL")
    wanted = good.filter("verdict = 'new'").select(F.trim("name").alias("name"), "entity_type", "summary").groupBy("name", "entity_type").agg(F.max("summary").alias("summary"))
    there = entities.groupBy("name", "entity_type").agg(F.min("id").alias("id"))
    made = next_ids(wanted.join(there, ["name", "entity_type"], "left_anti"), entities, ["name", "entity_type"])
    target = cut(made.select("name", "entity_type", "id", "summary").unionByName(wanted.join(there, ["name", "entity_type"]).select("name", "entity_type", "id", "summary")))
    key = target.select(F.col("name").alias("__n"), F.col("entity_type").alias("__t"), F.col("id").alias("__e"))
    done = good.join(key, (F.col("verdict") == "new") & (F.trim("name") == F.col("__n")) & (F.col("entity_type") == F.col("__t")), "left")
    done = cut(done.withColumn("to", F.when(F.col("verdict") == "existing", F.col("entity_id")).when(F.col("verdict") == "new", F.col("__e"))))
    status = done.select(F.col("review_id").alias("id"), F.when(F.col("verdict") == "dismiss", "dismissed").otherwise("resolved").alias("__s"), F.col("to").alias("resolved_entity_id"), F.when(F.col("verdict") == "existing", F.filter("candidates", lambda c: c != F.col("to"))).alias("rejected"))
    after = queue.join(status, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")
    spelled = done.filter("verdict = 'existing' AND said <> '' AND lower(said) <> lower(known_name)").groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_set("said")).alias("__more"))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    summary = target.select("id", F.col("summary").alias("__new")).filter("__new IS NOT NULL")
    kept = entities.join(spelled, "id", "left").join(summary, "id", "left")
    kept = kept.withColumns({"aliases": F.when(F.col("__more").isNull(), F.col("aliases")).otherwise(F.concat(own, F.array_except("__more", own))), "summary": F.coalesce("__new", "summary")}).drop("__more", "__new")
    added = made.select("id", "name", "entity_type", "summary")
    settled = done.filter("to IS NOT NULL")
    denied = done.filter("verdict = 'dismiss' AND said <> '' AND said_type IS NOT NULL").select(F.lower(F.trim("said")).alias("name"), F.col("said_type").alias("entity_type"), F.concat(F.lit("dismissed review "), F.col("review_id").cast("string")).alias("reason"))
    return Reviewed(
        after, kept.unionByName(added, allowMissingColumns=True), settled.select(F.col("to").alias("entity_id"), "chunk_id").distinct(),
        settled.select(F.col("said").alias("entity_name"), F.col("to").alias("resolved_to_id"), F.coalesce("reasoning", F.lit("")).alias("context")),
        denied.dropDuplicates(["name", "entity_type"]), met.filter("error IS NOT NULL").select("review_id", "error"),
    )


def added_relations(requests: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges (edge_id, source_id, target_id, relation_type, description) and errors (request_id, error).

    requests: request_id, source, target, relation_type, description. A name must be exactly one entity's, in any case;
    equal requests are edges of their own.
    """
    known = entities.groupBy(F.lower("name").alias("__k")).agg(F.count("*").alias("__n"), F.min("id").alias("__e"))
    out = requests
    for side in ("source", "target"):
        own = known.select(F.col("__k").alias(f"__{side}"), F.col("__n").alias(f"{side}_n"), F.col("__e").alias(f"{side}_id"))
        out = out.withColumn(f"__{side}", F.lower(F.trim(side))).join(own, f"__{side}", "left").drop(f"__{side}").fillna(0, [f"{side}_n"])

    def wrong(side: str) -> Column:
        return F.when(F.col(f"{side}_n") == 0, f"{side} not found").when(F.col(f"{side}_n") > 1, f"{side} is ambiguous")

    error = F.coalesce(wrong("source"), wrong("target"), F.when(~F.coalesce(F.col("relation_type").isin(list(V.RELATION_TYPES)), F.lit(False)), "relation_type is unknown"))
    out = cut(out.withColumn("error", error))
    good = next_ids(out.filter("error IS NULL"), edges, ["request_id"], "edge_id")
    return good.select("edge_id", "source_id", "target_id", "relation_type", "description"), out.filter("error IS NOT NULL").select("request_id", "error")


def corrected_relations(edges: DataFrame, patch: DataFrame, at: str) -> DataFrame:
    """edges after patch(edge_id, supersede, description): closing goes before describing, and closes active edges only."""
    new = patch.groupBy("edge_id").agg(F.bool_or(F.coalesce("supersede", F.lit(False))).alias("__close"), F.max("description").alias("__text"))
    out = edges.join(new, "edge_id", "left")
    closing = F.coalesce("__close", F.lit(False))
    closed = F.when(closing & F.col("superseded_at").isNull(), F.lit(at).cast(dict(edges.dtypes)["superseded_at"])).otherwise(F.col("superseded_at"))
    return out.withColumns({"superseded_at": closed, "description": F.when(closing, F.col("description")).otherwise(F.coalesce("__text", "description"))}).drop("__close", "__text")


def corrected_entities(entities: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities after patch(id, name, entity_type, summary, alias), one row an id, and errors (id, error).

    Non-null values replace the old ones, an alias is appended, also where it is there already. A change of name or type
    that another entity has, or that another change asks for, is an error and changes nothing of that entity.
    """
    new = patch.select("id", *(F.col(c).alias(f"__{c}") for c in ("name", "entity_type", "summary", "alias")), F.lit(True).alias("__hit"))
    met = cut(entities.join(new, "id", "left").withColumns({"__n": F.coalesce("__name", "name"), "__t": F.coalesce("__entity_type", "entity_type")}))
    moved = met.filter("__hit AND (NOT __n <=> name OR NOT __t <=> entity_type)")
    taken = entities.select(F.col("name").alias("__n"), F.col("entity_type").alias("__t")).unionByName(moved.groupBy("__n", "__t").count().filter("count > 1").select("__n", "__t")).distinct()
    clash = moved.join(taken, ["__n", "__t"], "left_semi").select("id", F.lit(True).alias("__clash"))
    missing = patch.join(entities.select("id"), "id", "left_anti").select("id", F.lit("entity not found").alias("error"))
    errors = clash.select("id", F.lit("name and type are taken").alias("error")).unionByName(missing)
    out = met.join(clash, "id", "left").withColumn("__go", F.coalesce("__hit", F.lit(False)) & F.col("__clash").isNull())
    pick = lambda n, c: F.when(F.col("__go"), F.coalesce(n, c)).otherwise(F.col(c))
    longer = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("__alias"))
    changed = {"name": pick("__n", "name"), "entity_type": pick("__t", "entity_type"), "summary": pick("__summary", "summary"), "aliases": F.when(F.col("__go") & F.col("__alias").isNotNull(), longer).otherwise(F.col("aliases"))}
    return out.withColumns(changed).select(entities.columns), errors
