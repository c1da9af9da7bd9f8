"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014).

A first pass contracts the links of each map partition to stars, the way a combiner would; what several partitions
share is then a small graph of labels, on which the two star operations alternate until nothing changes. Hubs are no
hot spot: minima are combined before the exchange and the join back is a sort-merge join AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.session import cut

BUFFER = 2_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and for each the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[label]
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pd.DataFrame:
        nodes, label = contract(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()
        return pd.DataFrame({"node": nodes, "label": label})

    size = 0
    for batch in batches:
        held.append((batch["src"].to_numpy(), batch["dst"].to_numpy()))
        size += len(batch)
        if size >= BUFFER:
            yield flush()
            size = 0
    if size:
        yield flush()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_rounds(edges: DataFrame) -> DataFrame:
    """(u, v): every node but a component's smallest with that smallest. edges: u, v, without loops."""
    edges = cut(edges.distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = cut(small_star(large_star(edges)))
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges


def connected_components(edges: DataFrame, block: Column | None = None) -> DataFrame:
    """(node, component) for every node of edges(src, dst: long); component is the smallest node linked to it.

    Loops and repeated links do no harm, rows with a null end are left out, an empty table gives no row. block: links
    that share it meet in one task of the first pass; it should hold most links of a component together yet be
    bounded (a session and a stretch of arrival, say). Without it the table's own partitions are contracted.
    """
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    if block is not None:
        edges = edges.repartition(block)
    stars = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInPandas(_stars, "node long, label long"))
    # a node with several labels links them
    ends = stars.groupBy("node").agg(F.min("label").alias("m"), F.max("label").alias("x")).filter("m < x").select("node", "m")
    links = stars.join(ends, "node").filter("label > m").select(F.col("label").alias("u"), F.col("m").alias("v"))
    final = star_rounds(links)
    named = stars.join(final.select(F.col("u").alias("label"), F.col("v").alias("c")), "label", "left")
    return named.groupBy("node").agg(F.min(F.coalesce("c", "label")).alias("component"))
