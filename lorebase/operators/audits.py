"""Quality audits of the knowledge graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import jaccard, trigrams
from lorebase.operators.graph import active
from lorebase.session import cut, exchanged


def similar_names(names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(kind, name_a, name_b, similarity): distinct names of one kind whose trigram sets overlap by more than threshold.

    names: kind, name. Exact all-pairs join by prefix filtering: with trigrams ordered from rare to common, two sets
    above the threshold share at least two of their first ``n - ceil(threshold * n) + 2`` trigrams, so pairs of rare
    trigrams are the join keys and common ones are none. Equal names are one; null names are left out.
    """
    sets = names.filter("name IS NOT NULL").select("kind", F.lower("name").alias("name")).distinct().withColumn("grams", trigrams("name")).filter(F.size("grams") > 0)
    sets = cut(sets.withColumn("id", F.xxhash64("kind", "name")))
    spread = sets.select("kind", F.explode("grams").alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("df"))
    keys = prefix_keys(sets, "id", spread, threshold)
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & fits).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    one, two = (sets.select(F.col("id").alias(i), F.col("kind").alias(f"k{i}"), F.col("name").alias(f"name{i}"), F.col("grams").alias(f"g{i}")) for i in "xy")
    scored = met.join(one, "x").join(two, "y").filter("kx = ky").withColumn("similarity", jaccard("gx", "gy"))
    return scored.filter(F.col("similarity") > threshold).select(F.col("kx").alias("kind"), F.least("namex", "namey").alias("name_a"), F.greatest("namex", "namey").alias("name_b"), "similarity")


def prefix_keys(sets: DataFrame, key: str, spread: DataFrame, threshold: float) -> DataFrame:
    """(key, kind, n, at, key): pairs of rare trigrams of sets(key, kind, grams), any two sets above threshold share one.

    spread: kind, gram, df. Every set has two trigrams or more, as words are padded. at is the place of the pair's later
    trigram in its set, for may_exceed().
    """
    single = sets.select(key, "kind", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(exchanged(spread), ["kind", "gram"], "left").fillna(0, ["df"])
    ordered = single.groupBy(key, "kind", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("g"))
    first = F.slice("g", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 2).cast("int"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.transform(F.slice("p", i + 1, F.size("p")), lambda g, j: F.struct((i + j + 1).alias("at"), F.xxhash64(F.col("kind"), F.least(F.element_at("p", i), g), F.greatest(F.element_at("p", i), g)).alias("key")))))
    return ordered.withColumn("p", first).filter(F.size("p") > 1).select(key, "kind", "n", F.explode(pairs).alias("x")).select(key, "kind", "n", "x.at", "x.key")


def may_exceed(threshold: float, n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether two sets that share a pair of prefix_keys can be above threshold, if the pair is the first two trigrams they share.

    Then the others they share come after it in both. A later shared pair of theirs may fail, their first one does not.
    """
    most = 2 + F.least(n - at, other_n - other_at)
    return most * (1 + threshold) > (n + other_n) * threshold - 1e-9


def orphans(entities: DataFrame, links: DataFrame, spared: Sequence[int] = (1, 2)) -> DataFrame:
    """Entities that no link names, except the speakers."""
    return entities.filter(~F.col("id").isin(list(spared))).join(links.select(F.col("entity_id").alias("id")), "id", "left_anti")


def broken_relations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge_id, side): active edges with a source or target that does not exist."""
    ids, live = entities.select("id"), active(edges)
    parts = [live.select("edge_id", F.col(f"{side}_id").alias("id")).join(ids, "id", "left_anti").select("edge_id", F.lit(side).alias("side")) for side in ("source", "target")]
    return parts[0].unionByName(parts[1])


def repeated(rows: DataFrame, keys: Sequence[str], id_col: str, order: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the count and the ids in order."""
    # the lists hold repeated rows only: keys are counted before anything is collected
    often = rows.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1").select(*(F.col(k).alias(f"__r_{k}") for k in keys), "cnt")
    met = rows.join(often, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    seen = met.groupBy(*keys, "cnt").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(id_col).alias("__id")))).alias("all"))
    return seen.select(*keys, "cnt", F.transform("all", lambda s: s["__id"]).alias("ids"))


def stale(entities: DataFrame, as_of: str, days: int = 90, least: int = 3, spared: Sequence[int] = (1, 2)) -> DataFrame:
    """Entities not used for days (or never) and fewer than least times."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    old = F.col("last_accessed_at").isNull() | (F.col("last_accessed_at").cast("timestamp") < limit)
    return entities.filter(~F.col("id").isin(list(spared)) & old & (F.coalesce("access_count", F.lit(0)) < least))
