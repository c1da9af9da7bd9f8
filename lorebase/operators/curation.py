"""Curation of extracted entities and relations: validation, routing, maintenance, and tables rewritten from patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import vocabulary as V
from lorebase.functions.text import trigrams
from lorebase.operators.audits import may_exceed, prefix_keys
from lorebase.session import cut, exchanged


def _errors(checks: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for bad, message in checks)))


def entity_errors() -> Column:
    """Messages for what is wrong with name, entity_type, match and confidence; an empty list if nothing is."""
    return _errors([
        (F.trim(F.coalesce("name", F.lit(""))) == "", "name is missing"),
        (~F.col("entity_type").isin(list(V.ENTITY_TYPES)), "entity_type is unknown"),
        (~F.col("match").isin("existing", "new", "uncertain"), "match is unknown"),
        (~F.col("confidence").between(0, 1), "confidence is not between 0 and 1"),
    ])


def relation_errors() -> Column:
    return _errors([
        (F.trim(F.coalesce("source", F.lit(""))) == "", "source is missing"),
        (F.trim(F.coalesce("target", F.lit(""))) == "", "target is missing"),
        (~F.col("relation_type").isin(list(V.RELATION_TYPES)), "relation_type is unknown"),
    ])


def fuzzy_candidates(proposals: DataFrame, entities: DataFrame, threshold: float = V.FUZZY_THRESHOLD, most: int = 5) -> DataFrame:
    """(proposal_id, candidates): up to most entities of the type whose names' trigrams overlap by more than threshold.

    Prefix filtering as in the duplicate audit: trigrams ordered by how rare they are among the entities.
    """
    known = cut(entities.select("id", F.col("entity_type").alias("kind"), trigrams(F.lower("name")).alias("grams")))
    asked = cut(proposals.select("proposal_id", F.col("entity_type").alias("kind"), trigrams(F.lower(F.trim("name"))).alias("grams")))
    spread = known.select("kind", F.explode("grams").alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("df"))
    a, b = prefix_keys(asked, "proposal_id", spread, threshold).alias("a"), prefix_keys(known, "id", spread, threshold).alias("b")
    able = may_exceed(threshold, *(F.col(c) for c in ("a.n", "a.at", "b.n", "b.at")))
    met = a.join(exchanged(b), (F.col("a.key") == F.col("b.key")) & able).select("proposal_id", "id").distinct()
    scored = met.join(exchanged(asked.select("proposal_id", F.col("grams").alias("ga"))), "proposal_id").join(exchanged(known.select("id", F.col("grams").alias("gb"))), "id")
    both = F.size(F.array_intersect("ga", "gb"))
    scored = scored.withColumn("similarity", both / (F.size("ga") + F.size("gb") - both)).filter(F.col("similarity") > threshold)
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.col("similarity").desc(), "id"))).filter(F.col("r") <= most)
    return best.groupBy("proposal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("fuzzy"))


def route_entities(proposals: DataFrame, entities: DataFrame, denied: DataFrame) -> DataFrame:
    """proposals(proposal_id, name, entity_type, match, confidence) with action, entity_id, reason and candidates.

    The order of the checks decides: speaker, denied name, exact name, name under another type, alias, similar
    names, new with enough confidence; everything else is for review. All lookups see one snapshot of the entities.
    Similar names are looked for only where no check before them decides.
    """
    asked = proposals.withColumn("__key", F.lower(F.trim("name")))
    exact = entities.groupBy(F.lower("name").alias("__key"), "entity_type").agg(F.min("id").alias("exact_id"))
    anyhow = entities.groupBy(F.lower("name").alias("__key")).agg(F.min("id").alias("cross_id"))
    alias = entities.select("id", "entity_type", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("__key"), "entity_type").agg(F.min("id").alias("alias_id"))
    barred = denied.select(F.lower("name").alias("__key"), "entity_type").distinct().withColumn("denied", F.lit(True))
    out = asked.join(exchanged(exact), ["__key", "entity_type"], "left").join(exchanged(anyhow), "__key", "left").join(exchanged(alias), ["__key", "entity_type"], "left").join(exchanged(barred), ["__key", "entity_type"], "left")
    out = cut(out)
    speaker = reduce(lambda c, s: c.when(F.col("__key") == s[1].lower(), F.lit(s[0])), V.SPEAKERS.items(), F.when(F.lit(False), F.lit(0)))
    open_ = out.filter(speaker.isNull() & F.coalesce("exact_id", "cross_id", "alias_id").isNull() & F.col("denied").isNull())
    out = out.join(exchanged(fuzzy_candidates(open_, entities)), "proposal_id", "left")
    sure = F.col("confidence") >= V.EXISTING_THRESHOLD
    fields = lambda action, entity, reason: F.struct(F.lit(action).alias("action"), entity.cast("long").alias("entity_id"), F.lit(reason).alias("reason"))
    none = F.lit(None)
    verdict = (
        F.when(speaker.isNotNull(), fields("singleton", speaker, "speaker"))
        .when(F.col("denied"), fields("skip", none, "denied"))
        .when(F.col("exact_id").isNotNull() & sure, fields("apply_existing", F.col("exact_id"), "exact"))
        .when(F.col("exact_id").isNotNull(), fields("review", F.col("exact_id"), "exact, low confidence"))
        .when(F.col("cross_id").isNotNull(), fields("review", F.col("cross_id"), "other type"))
        .when(F.col("alias_id").isNotNull() & sure, fields("apply_existing", F.col("alias_id"), "alias"))
        .when(F.col("alias_id").isNotNull(), fields("review", F.col("alias_id"), "alias, low confidence"))
        .when(F.col("fuzzy").isNotNull(), fields("review", F.get("fuzzy", F.lit(0)), "similar"))
        .when((F.col("match") == "new") & (F.col("confidence") >= V.NEW_THRESHOLD), fields("create_new", none, "new"))
        .otherwise(fields("review", none, "below threshold"))
    )
    asked_of = F.when(F.col("v.action") == "review", F.when(F.col("v.reason") == "similar", F.col("fuzzy")).when(F.col("v.entity_id").isNotNull(), F.array("v.entity_id")))
    return out.withColumn("v", verdict).select("proposal_id", "name", "entity_type", "v.action", "v.entity_id", "v.reason", asked_of.alias("candidates"))


def route_relations(relations: DataFrame, applied: DataFrame) -> DataFrame:
    """relations(relation_id, chunk_id, source, target, relation_type) with ids of both ends and action.

    Names are resolved among the speakers and the entities applied in the same chunk: applied(chunk_id, name, entity_id).
    """
    speaker = lambda c: reduce(lambda x, s: x.when(F.lower(F.trim(c)) == s[1].lower(), F.lit(s[0])), V.SPEAKERS.items(), F.when(F.lit(False), F.lit(0)))
    known = applied.groupBy("chunk_id", F.lower(F.trim("name")).alias("k")).agg(F.min("entity_id").alias("e"))
    out = relations
    for side in ("source", "target"):
        found = known.select("chunk_id", F.col("k").alias(f"__{side}"), F.col("e").alias(f"__{side}_e"))
        out = out.withColumn(f"__{side}", F.lower(F.trim(side))).join(exchanged(found), ["chunk_id", f"__{side}"], "left")
        out = out.withColumn(f"{side}_id", F.coalesce(speaker(F.col(side)).cast("long"), F.col(f"__{side}_e"))).drop(f"__{side}", f"__{side}_e")
    action = F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "skip: unresolved").when(F.col("source_id") == F.col("target_id"), "skip: itself").otherwise("apply")
    return out.withColumn("action", action)


def type_votes(entities: DataFrame, edges: DataFrame, name_hints: Mapping[str, str] = V.NAME_HINTS) -> DataFrame:
    """(entity_id, current_type, suggested_type, confidence): weighted votes of relations (1) and name parts (2).

    suggested_type is NULL where the current type wins or nothing votes (confidence 1); ties go to the first type by name.
    """
    hints = lambda role, rules: F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("relation_type")]
    live = edges.filter(F.col("superseded_at").isNull())
    votes = live.select(F.col("source_id").alias("id"), hints("source", V.SOURCE_HINTS).alias("type"), F.lit(1).alias("w"))
    votes = votes.unionByName(live.select(F.col("target_id").alias("id"), hints("target", V.TARGET_HINTS).alias("type"), F.lit(1).alias("w")))
    named = F.array_compact(F.array(*(F.when(F.lower("name").contains(part), F.lit(kind)) for part, kind in name_hints.items())))
    votes = votes.unionByName(entities.select("id", F.explode(named).alias("type"), F.lit(2).alias("w")))
    summed = votes.filter("type IS NOT NULL").groupBy("id", "type").agg(F.sum("w").alias("w"))
    top = summed.groupBy("id").agg(F.min_by("type", F.struct(-F.col("w"), "type")).alias("top"), F.max("w").alias("most"), F.sum("w").alias("total"))
    out = entities.select("id", "entity_type").join(top, "id", "left")
    return out.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("current_type"), F.when(F.col("top") != F.col("entity_type"), F.col("top")).alias("suggested_type"), F.coalesce(F.col("most") / F.col("total"), F.lit(1.0)).alias("confidence"))


def summaries(entities: DataFrame, links: DataFrame, chunks: DataFrame, newest: int = 10, most: int = 5) -> DataFrame:
    """(entity_id, summary): the first sentences naming the entity in its newest chunks, each once.

    Falls back to the stored summary, then to the newest chunk's first 200 characters. The newest chunks are taken by
    a group limit before texts are split, so an entity linked to a tenth of all chunks costs ten texts.
    """
    linked = links.join(chunks.select(F.col("id").alias("chunk_id"), "created_at"), "chunk_id")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("chunk_id").desc()))
    recent = linked.withColumn("r", rank).filter(F.col("r") <= newest).select("entity_id", "chunk_id", "r")
    texts = recent.join(chunks.select(F.col("id").alias("chunk_id"), "raw_content"), "chunk_id").join(entities.select(F.col("id").alias("entity_id"), "name", "summary"), "entity_id")
    parts = texts.select("entity_id", "name", "r", F.posexplode(F.split(F.replace("raw_content", F.lit("\n"), F.lit(" ")), r"\. ")).alias("p", "s"))
    parts = parts.withColumn("s", F.rtrim(F.regexp_replace(F.trim("s"), r"\.+$", ""))).filter("s <> ''").filter(F.lower("s").contains(F.lower("name")))
    once = parts.groupBy("entity_id", F.lower("s").alias("k")).agg(F.min(F.struct("r", "p", "s")).alias("x"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("x"))).filter(F.col("n") <= most)
    made = first.groupBy("entity_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ". "), F.lit(".")).alias("made"))
    spare = texts.filter("r = 1").select("entity_id", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.substring("raw_content", 1, 200)).alias("spare"))
    return spare.join(made, "entity_id", "left").select("entity_id", F.coalesce("made", "spare").alias("summary"))


def upserted(entities: DataFrame, patch: DataFrame) -> DataFrame:
    """entities after patch(name, entity_type, summary): a new summary replaces the old unless it is NULL; action tells
    created, updated or kept. Of several patches for one entity the last by summary counts; new rows have no id yet."""
    key = ["name", "entity_type"]
    once = patch.groupBy(*key).agg(F.max("summary").alias("__new"), F.lit(True).alias("__hit"))
    out = entities.join(once, key, "full_outer")
    action = F.when(F.col("id").isNull(), "created").when(F.col("__hit"), "updated").otherwise("kept")
    return out.withColumns({"action": action, "summary": F.coalesce("__new", "summary")}).drop("__new", "__hit")


def merged_aliases(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, aliases) of merge targets: own aliases, then each source's name and aliases, first spelling kept.

    merges: source_id, target_id.
    """
    src = merges.join(entities.select(F.col("id").alias("source_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("a")), "source_id")
    gained = src.groupBy("target_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "name", "a"))), lambda x: F.concat(F.array(x["name"]), x["a"]))).alias("more"))
    own = entities.select(F.col("id").alias("target_id"), F.coalesce("aliases", F.array().cast("array<string>")).alias("own"))
    return gained.join(own, "target_id").select(F.col("target_id").alias("id"), F.array_distinct(F.concat("own", "more")).alias("aliases"))


def merged_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """entity_chunks with merged entities' links moved to their targets, each link once."""
    out = links.join(merges.withColumnRenamed("source_id", "entity_id"), "entity_id", "left")
    return out.select(F.coalesce("target_id", "entity_id").alias("entity_id"), "chunk_id").distinct()


def merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges repointed to merge targets, without loops; of equal active edges the first by edge_id stays."""
    for side in ("source", "target"):
        map_ = merges.select(F.col("source_id").alias(f"{side}_id"), F.col("target_id").alias("__to"))
        edges = edges.join(map_, f"{side}_id", "left").withColumn(f"{side}_id", F.coalesce("__to", f"{side}_id")).drop("__to")
    kept = edges.filter("source_id <> target_id")
    rank = F.row_number().over(Window.partitionBy("source_id", "target_id", "relation_type", "superseded_at").orderBy("edge_id"))
    return kept.withColumn("__n", rank).filter(F.col("superseded_at").isNotNull() | (F.col("__n") == 1)).drop("__n")


def corrected(rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the non-null columns of patch (one row per key) in place of their own."""
    new = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


def added_denials(denied: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Names (trimmed, lower case) and types of dismissed that are not denied yet, each once."""
    fresh = dismissed.select(F.lower(F.trim("name")).alias("name"), "entity_type").filter("name <> ''").distinct()
    return fresh.join(denied.select(F.lower("name").alias("name"), "entity_type"), ["name", "entity_type"], "left_anti")


def without_denial(denied: DataFrame, name: str, entity_type: str) -> DataFrame:
    return denied.filter(~((F.lower("name") == name.strip().lower()) & (F.col("entity_type") == entity_type)))


def resolve_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with entity_id where exactly one entity has the name in any case, and n, how many have it."""
    known = entities.groupBy(F.lower("name").alias("__k")).agg(F.count("*").alias("n"), F.min("id").alias("e"))
    out = names.withColumn("__k", F.lower(F.trim("name"))).join(known, "__k", "left").fillna(0, ["n"])
    return out.select("name", F.when(F.col("n") == 1, F.col("e")).alias("entity_id"), "n")


def put(kv: DataFrame, entries: DataFrame) -> DataFrame:
    """Key-value table after entries(key, content, updated_at): trimmed, blank ones ignored, last by updated_at wins."""
    new = entries.withColumns({"key": F.trim("key"), "content": F.trim("content")}).filter("key <> '' AND content <> ''")
    both = kv.select("key", "content", "updated_at").unionByName(new.select("key", "content", "updated_at"))
    return both.groupBy("key").agg(F.max_by("content", "updated_at").alias("content"), F.max("updated_at").alias("updated_at"))


def next_ids(new: DataFrame, existing: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Ids for new rows: after the largest stored one, in the given order (a single writer, a batch at a time).

    The rows are sorted over all tasks and written; an id is the size of the tasks before plus the place in the own one.
    """
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    placed = cut(new.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a task
    base = sizes.withColumn("__base", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    out = placed.join(F.broadcast(base), "__part").join(F.broadcast(top), F.lit(True))
    return out.withColumn(id_col, F.col("__top") + F.col("__base") + F.col("__row") + 1).drop("__at", "__part", "__row", "__base", "__top")
