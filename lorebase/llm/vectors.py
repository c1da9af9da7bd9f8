"""Most similar vectors: a hierarchical k-means tree searched best bin first.

The tree is fitted on bounded samples; every vector is indexed. The first level is fitted on ``fit_rows`` vectors; where
its leaves would be too large, each becomes a cell with a tree of its own, fitted by a task on as many of the cell's
vectors, and so on, so the number of leaves follows the rows at any size and no tree outgrows its sample. A search pops
the best bin of a priority queue, opens inner nodes, and widens until it has visited as many leaves as the calibration
on the sample says are needed for the recall asked, up to all of them. Copies of a direction are one class, so a vector
that a third of all rows share costs one search. A leaf gives every visitor, and every member, its best few only; large
leaves and crowds of visitors are split. Vectors travel as 16-bit floats; what they find is recomputed from the stored ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import cut

FIT_ROWS = 32_768
SAMPLE_PER_LEAF = 8
LEAF_ROWS = 2_048
PART_ROWS = 8_192  # members of a leaf that one task compares
VISITOR_ROWS = 131_072  # visitors of a leaf that one task compares
SPARE = 22  # how many more than k a leaf gives, as 16-bit rounding may change the order
SLACK = 0.004  # what 16-bit rounding can take from a similarity, and a margin


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _assign(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Tree:
    """centre of each node, first child and number of children (0: a leaf), leaf number, parts of a leaf's members and groups of its visitors."""

    centre: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    parts: np.ndarray
    groups: np.ndarray
    visits: int = 1

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.search(x, 1)[:, 0]

    def search(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Leaf numbers of the first visits leaves of each row in best-bin-first order (-1 after the last leaf)."""
        n = len(x)
        out = np.full((n, visits), -1, dtype=np.int32)
        root = np.arange(self.child[0], self.child[0] + self.children[0])
        half = (self.centre**2).sum(1) / 2
        bins = [np.broadcast_to(root, (n, len(root)))]
        near = [x @ self.centre[root].T - half[root]]
        bins, near = np.concatenate(bins, 1), np.concatenate(near, 1).copy()
        have, rows = np.zeros(n, dtype=np.int64), np.arange(n)
        while len(rows):
            best = near[rows].argmax(1)
            node, empty = bins[rows, best], np.isneginf(near[rows, best])
            near[rows, best] = -np.inf
            leaf = (self.children[node] == 0) & ~empty
            at = rows[leaf]
            out[at, have[at]] = self.leaf[node[leaf]]
            have[at] += 1
            inner, rows_in = node[~leaf & ~empty], rows[~leaf & ~empty]
            if len(inner):
                width = self.children[inner].max()
                more = self.child[inner][:, None] + np.arange(width)
                dead = np.arange(width) >= self.children[inner][:, None]
                more = np.where(dead, 0, more)
                gap = np.einsum("ij,ikj->ik", x[rows_in], self.centre[more]) - half[more]
                gap[dead] = -np.inf
                # free columns of a row are reused, so the queue stays as wide as the bins that are open
                bins = np.concatenate([bins, np.zeros((n, width), dtype=bins.dtype)], 1)
                near = np.concatenate([near, np.full((n, width), -np.inf, dtype=near.dtype)], 1)
                bins[rows_in, -width:], near[rows_in, -width:] = more, gap
            rows = rows[~empty & (have[rows] < visits)]
        return out


def fit(sample: np.ndarray, rows: int, leaves: int, seed: int = 7) -> Tree:
    """Tree of about leaves leaves for rows vectors, from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    leaves = max(1, min(leaves, len(sample) // SAMPLE_PER_LEAF))
    fan = max(2, int(np.ceil(leaves**0.5)))
    centre, child, children, members = [np.zeros(sample.shape[1], dtype=np.float32)], [0], [0], [np.arange(len(sample))]
    todo = [0]
    per_leaf = max(1.0, len(sample) / leaves)
    while todo:
        node = todo.pop()
        own = members[node]
        k = min(fan, int(np.ceil(len(own) / per_leaf)), len(own))
        if node and (k < 2 or len(own) < 1.5 * per_leaf):
            continue
        centres = _kmeans(sample[own], max(1, k), rng)
        at = _assign(sample[own], centres)
        child[node], children[node] = len(centre), len(centres)
        for i, c in enumerate(centres):
            inside = own[at == i]
            if len(centres) > 1 and len(inside) < len(own):
                todo.append(len(centre))
            centre.append(c)
            child.append(0)
            children.append(0)
            members.append(inside)
    children_ = np.array(children)
    leaf = np.where(children_ == 0, np.cumsum(children_ == 0) - 1, -1)
    share = np.array([len(m) for m, c in zip(members, children, strict=True) if c == 0]) / max(1, len(sample))
    parts = np.maximum(1, np.ceil(share * rows / PART_ROWS)).astype(np.int64)
    return Tree(np.array(centre, dtype=np.float32), np.array(child), children_, leaf, parts, np.ones_like(parts))


def crowded(tree: Tree, sample: np.ndarray, asking: float) -> Tree:
    """The tree with the groups of visitors each leaf will need when asking vectors search it, judged by the sample."""
    met = tree.search(sample[:: max(1, len(sample) // 4_096)], tree.visits)
    share = np.bincount(met[met >= 0], minlength=len(tree.parts)) / max(1, len(met))
    tree.groups = np.maximum(1, np.ceil(share * asking / VISITOR_ROWS)).astype(np.int64)
    return tree


def visits_for_pairs(tree: Tree, sample: np.ndarray, least: float, recall: float, seed: int = 11) -> int:
    """Leaf visits after which all but 1 - recall of partners at similarity least are met, from either side."""
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(4_000, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape).astype(np.float32)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    y = least * x + (1 - least**2) ** 0.5 * noise
    place = lambda s, home: np.where((s == home[:, None]).any(1), (s == home[:, None]).argmax(1), s.shape[1])
    visits, leaves = min(32, len(tree.parts)), len(tree.parts)
    while True:
        a, b = tree.search(x, visits), tree.search(y, visits)
        worst = np.sort(np.minimum(place(a, b[:, 0]), place(b, a[:, 0])))
        need = int(worst[min(len(worst) - 1, int(np.ceil(recall * len(worst))))]) + 1
        if need <= visits or visits >= leaves:
            return min(need, leaves)
        visits = min(leaves, visits * 2)


def visits_for_nearest(tree: Tree, sample: np.ndarray, k: int, recall: float, seed: int = 13) -> int:
    """Leaf visits that find recall of the k nearest of sample rows among the sample, by brute force."""
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    truth = np.argpartition(-near, k - 1, axis=1)[:, :k]
    home, leaves = tree.home(sample), int((tree.children == 0).sum())
    order = tree.search(sample[asked], leaves)
    place = np.empty((len(asked), leaves), dtype=np.int64)
    rows = np.arange(len(asked))[:, None]
    place[rows, order] = np.arange(leaves)
    need = np.sort(place[rows, home[truth]].ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))] + 1)


def length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and half (the direction in 16-bit floats), for vectors that are neither null, empty nor zero and hold neither
    null nor NaN nor infinity."""
    ok = (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("n", length("v")).filter("n > 0 AND n < double('Infinity')")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.groupby(batch["v"].map(len)):
                half = (np.stack(b["v"].to_numpy()).astype(np.float64) / b["n"].to_numpy()[:, None]).astype(np.float16)
                half[half == 0] = 0  # no negative zero
                yield pd.DataFrame({"id": b["id"], "half": [r.tobytes() for r in half]})

    return rows.select("id", "v", "n").mapInPandas(run, "id long, half binary")


def classes(df: DataFrame, key: str, vector: str, size: int | None, asked: Column) -> tuple[DataFrame, DataFrame, int]:
    """Members (id, rep), one row per direction (rep: its smallest id, half, copies, asked), and the width of the vectors.

    Without size the most frequent width counts. Directions meet under 128 bits of hash, so their bytes are moved once.
    """
    halves = cut(usable(df, key, vector))
    if size is None:
        widths = halves.groupBy(F.length("half").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).first()
        size = widths.w // 2 if widths else 1
    own = halves.filter(F.length("half") == 2 * size).select("id", "half", F.xxhash64("half").alias("h1"), F.xxhash64("half", F.lit(1)).alias("h2"))
    grouped = own.groupBy("h1", "h2").agg(F.min_by("half", "id").alias("half"), F.min("id").alias("rep"), F.count("*").alias("copies"), F.bool_or(asked).alias("asked"))
    reps = cut(grouped)
    members = own.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    return members, reps.drop("h1", "h2"), size


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float16).reshape(-1, size).astype(np.float32)


def sampled(reps: DataFrame, rows: int, size: int, fit_rows: int) -> np.ndarray:
    """About fit_rows of the rows classes, chosen by a hash of their names, so each task sends its own share only."""
    share = min(1.0, fit_rows / max(1, rows))
    chosen = reps.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "half").toPandas().sort_values("rep")
    x = _matrix(chosen["half"], size) if len(chosen) else np.zeros((0, size), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


HASH = 0x9E3779B1


def _placed(tree: Tree, base: int, rep: np.ndarray, half: np.ndarray, home: np.ndarray, asks: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
    """Rows (leaf, part, team, rep, half, home): members in their leaf, once for each group of its visitors, and visitors
    in each part of the leaves they visit."""
    for start in range(0, len(rep), 2_048):
        cut_ = slice(start, start + 2_048)
        x, own, bytes_ = _matrix(half[cut_], size), rep[cut_], half[cut_]
        at, seek = np.flatnonzero(home[cut_]), np.flatnonzero(asks[cut_])
        mix = own * HASH % 2**32
        leaf = tree.home(x[at]) if len(at) else np.zeros(0, np.int64)
        times = tree.groups[leaf]
        i, leaf = np.repeat(at, times), np.repeat(leaf, times)
        team = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
        yield pd.DataFrame({"leaf": base + leaf.astype(np.int64), "part": (mix[i] % tree.parts[leaf]).astype(np.int32), "team": team.astype(np.int32), "rep": own[i], "half": bytes_[i], "home": True})
        if len(seek):
            found = tree.search(x[seek], tree.visits)
            row, col = np.nonzero(found >= 0)
            leaf = found[row, col]
            times = tree.parts[leaf]
            i, leaf = np.repeat(seek[row], times), np.repeat(leaf, times)
            part = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"leaf": base + leaf.astype(np.int64), "part": part.astype(np.int32), "team": (mix[i] // 7 % tree.groups[leaf]).astype(np.int32), "rep": own[i], "half": bytes_[i], "home": False})


def _routed(tree: Tree, base: int, rep: np.ndarray, half: np.ndarray, home: np.ndarray, asks: np.ndarray, size: int) -> Iterator[pd.DataFrame]:
    """Rows (cell, rep, half, home, asks): vectors in the cells of the next level they live in or visit."""
    for start in range(0, len(rep), 2_048):
        cut_ = slice(start, start + 2_048)
        x, own, bytes_, h, q = _matrix(half[cut_], size), rep[cut_], half[cut_], home[cut_], asks[cut_]
        found = tree.search(x, tree.visits)
        row, col = np.nonzero((found >= 0) & (q[:, None] | (np.arange(found.shape[1]) == 0)))
        lives = h[row] & (col == 0)
        keep = lives | q[row]
        row, col, lives = row[keep], col[keep], lives[keep]
        yield pd.DataFrame({"cell": base + found[row, col].astype(np.int64), "rep": own[row], "half": bytes_[row], "home": lives, "asks": q[row]})


PLACED = "leaf long, part int, team int, rep long, half binary, home boolean"
ROUTED = "cell long, rep long, half binary, home boolean, asks boolean"
Calibrate = Callable[[Tree, np.ndarray], int]


def _columns(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return b["rep"].to_numpy(), b["half"].to_numpy(), b["home"].to_numpy().astype(bool), b["asks"].to_numpy().astype(bool)


def spread(reps: DataFrame, size: int, calibrate: Calibrate, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame | None:
    """The rows of _placed for all reps (rep, half, asked), None if there are none.

    Levels are added until fit_rows / SAMPLE_PER_LEAF leaves a tree suffice for leaves of leaf_rows; what is broadcast
    or held by a task is one tree, bounded by its sample.
    """
    spark = reps.sparkSession
    rows, asking = reps.agg(F.count("*"), F.count_if("asked")).first()
    sample = sampled(reps, rows, size, fit_rows)
    if not len(sample):
        return None
    most = max(2, fit_rows // SAMPLE_PER_LEAF)
    wanted = max(1, rows // leaf_rows)
    levels = max(1, math.ceil(math.log(wanted) / math.log(most))) if wanted > 1 else 1
    fan = math.ceil(wanted ** (1 / levels))
    tree = fit(sample, rows, fan)
    tree.visits = calibrate(tree, sample)
    shared = spark.sparkContext.broadcast(crowded(tree, sample, asking))
    act, schema = (_placed, PLACED) if levels == 1 else (_routed, ROUTED)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from act(shared.value, 0, *_columns(b), size)

    at = reps.select("rep", "half", F.lit(True).alias("home"), F.col("asked").alias("asks")).mapInPandas(first, schema)
    for level in range(2, levels + 1):
        at = _next_level(cut(at), size, calibrate, fit_rows, fan, level == levels)
    return at


def _next_level(at: DataFrame, size: int, calibrate: Calibrate, fit_rows: int, fan: int, last: bool) -> DataFrame:
    """Each cell's rows through the cell's own tree, in groups of bounded size."""
    sizes = at.groupBy("cell").agg(F.count_if("home").alias("rows"), F.count_if("asks").alias("asking"), F.count("*").alias("every"))
    salts = max(1, -(-(sizes.agg(F.max("every")).first()[0] or 1) // VISITOR_ROWS))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep")
    chosen = at.filter("home").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fit_rows).join(sizes, "cell").select("cell", "rows", "asking", "half")

    def fit_cell(group: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(group["half"], size)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        tree = fit(x, int(group["rows"].iloc[0]), fan)
        tree.visits = calibrate(tree, x)
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "tree": [pickle.dumps(crowded(tree, x, int(group["asking"].iloc[0])))]})

    trees = cut(chosen.groupBy("cell").applyInPandas(fit_cell, "cell long, tree binary")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    act, schema = (_placed, PLACED) if last else (_routed, ROUTED)

    def through(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        # a cell in which nobody lives has nothing to find
        empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        if not len(group) or not len(own):
            return empty
        base = int(group["cell"].iloc[0]) * (fit_rows // SAMPLE_PER_LEAF + 1)
        return pd.concat([empty, *act(pickle.loads(own["tree"].iloc[0]), base, *_columns(group), size)])

    salted = at.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
    return salted.groupBy("cell", "salt").cogroup(trees.groupBy("cell", "salt")).applyInPandas(through, schema)


def _best(asking: np.ndarray, names: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Which of the triples are among the keep best of their asking or of their names; equal ones by the smaller partner."""
    good = np.zeros(len(near), dtype=bool)
    for own, other in ((asking, names), (names, asking)):
        order = np.lexsort((other, -near, own))
        first = np.r_[True, own[order][1:] != own[order][:-1]] if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        good[order[place < keep]] = True
    return good


def _pairs_in_leaf(size: int, least: float, keep: int):
    """Pairs of a leaf at least least similar, for each visitor and each member its keep best at most."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        home = group["home"].to_numpy()
        x = _matrix(group["half"], size)
        rep = group["rep"].to_numpy()
        members, names = x[home], rep[home]
        visitors, asking = x[~home], rep[~home]
        a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(members):
            for start in range(0, len(visitors), 2_048):
                near = visitors[start : start + 2_048] @ members.T
                q, m = np.nonzero(near >= least)
                other = asking[start + q] != names[m]
                q, m = q[other], m[other]
                a, b, s = np.r_[a, asking[start + q]], np.r_[b, names[m]], np.r_[s, near[q, m]]
                if len(a) > 4 * keep * len(members):
                    good = _best(a, b, s, keep)
                    a, b, s = a[good], b[good], s[good]
            good = _best(a, b, s, keep)
            a, b = a[good], b[good]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot / (length(a) * length(b))


def close_pairs(df: DataFrame, key: str, vector: str, size: int | None, least: float, k: int, recall: float = 0.999, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: similarity at least least, one among the k most similar of the other.

    Ties go to the smaller id, so a class of copies gives about k pairs per row and not all of its pairs. Null and zero
    vectors and vectors of another size (None: of another size than most) take no part; repeated ids should not occur; an
    empty table gives no row.
    """
    member, reps, size = classes(df, key, vector, size, F.lit(True))
    pairs = spread(reps, size, lambda tree, sample: visits_for_pairs(tree, sample, least, recall), fit_rows, leaf_rows)
    if pairs is None:
        return df.sparkSession.createDataFrame([], "id_a long, id_b long, similarity double")
    pairs = pairs.groupBy("leaf", "part", "team").applyInPandas(_pairs_in_leaf(size, least - SLACK, k + SPARE), "a long, b long").distinct()
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.union(reps.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    # at most k + 1 rows of a class can be among the k most similar of anything
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1).drop("n")
    met = both.join(member.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(first.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").filter("x <> y").select("x", "y")
    met = cut(met)
    stored = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    once = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    exact = once.join(stored.select(F.col("id").alias("x"), F.col("v").alias("vx")), "x").join(stored.select(F.col("id").alias("y"), F.col("v").alias("vy")), "y")
    exact = exact.select("x", "y", cosine("vx", "vy").alias("similarity")).filter(F.col("similarity") >= least - 1e-9)
    sided = exact.union(exact.select(F.col("y"), F.col("x"), "similarity"))
    order = Window.partitionBy("x").orderBy(F.round("similarity", 6).desc(), F.col("y"))
    top = sided.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return top.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def _nearest_in_leaf(size: int, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        home = group["home"].to_numpy()
        x, rep = _matrix(group["half"], size), group["rep"].to_numpy()
        members, names = x[home], rep[home]
        visitors, asking = x[~home], rep[~home]
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0, np.float32)})]
        if len(members):
            take = min(k + 1, len(members))
            for start in range(0, len(visitors), 2_048):
                near = visitors[start : start + 2_048] @ members.T
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                rows = np.repeat(np.arange(len(near)), take)
                out.append(pd.DataFrame({"a": asking[start + rows], "b": names[best.ravel()], "s": near[rows, best.ravel()]}))
        return pd.concat(out)

    return run


def nearest(df: DataFrame, queries: Column, key: str, vector: str, size: int | None, k: int, recall: float = 0.95, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, neighbour, similarity, place): the k most similar rows of all rows, for the rows for which queries holds.

    queries is a condition on ``id``. Approximate with the recall the tree is calibrated for; similarities are exact.
    """
    member, reps, size = classes(df, key, vector, size, queries)
    at = spread(reps, size, lambda tree, sample: visits_for_nearest(tree, sample, k, recall), fit_rows, leaf_rows)
    if at is None:
        return df.sparkSession.createDataFrame([], "id long, neighbour long, similarity double, place int")
    met = at.groupBy("leaf", "part", "team").applyInPandas(_nearest_in_leaf(size, k), "a long, b long, s float")
    short = met.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), F.col("b")))).filter(F.col("n") <= k + 6).select("a", "b")
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1).drop("n")
    asked = member.filter(queries).select(F.col("id").alias("x"), F.col("rep").alias("a"))
    pairs = short.join(asked, "a").join(first.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").filter("x <> y").select("x", "y").distinct()
    stored = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    exact = cut(pairs).join(stored.select(F.col("id").alias("x"), F.col("v").alias("vx")), "x").join(stored.select(F.col("id").alias("y"), F.col("v").alias("vy")), "y")
    exact = exact.select("x", "y", cosine("vx", "vy").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.col("similarity").desc(), F.col("y")))
    return exact.withColumn("place", place).filter(F.col("place") <= k).select(F.col("x").alias("id"), F.col("y").alias("neighbour"), "similarity", "place")
