"""One ranking from several scores: Borda count over competition ranks.

Each score is ranked by itself, so its range and tails do not matter. Rows of one group may be any number: equal values
are counted first, and the values of a group with more than ``bucket_rows`` distinct ones are cut into ordered buckets
at mergeable approximate quantiles; a rank is the size of the better buckets plus the place inside the own one. So no
task ever orders a whole hot group, and the result is exact whatever the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import cut

BUCKET_ROWS = 100_000
STRETCH = 1 << 16


def usable(col: str, dtype: str) -> Column:
    """Score as double; NaN counts as missing. Times count in microseconds."""
    if dtype.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def value_ranks(values: DataFrame, group: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Ranks of the distinct (group, score, value) of values: ties (rows with it) and better (rows above it).

    A group of more than bucket_rows distinct values is cut into as many buckets of about half of that as the largest
    group needs; the result is the same for any bucket_rows, which only bounds what one task orders.
    """
    keys = [*group, "score"]
    counts = cut(values.filter("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("ties")))
    # cuts only for groups with too many values; the list of quantiles has a fixed length
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    largest = sizes.agg(F.max("n")).first()[0]
    buckets = 2 * -(-(largest or 0) // bucket_rows)
    cuts = F.percentile_approx("value", [i / max(1, buckets) for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("cuts")
    hot = None if largest is None else _nullsafe_join(counts, sizes.drop("n"), keys, "inner").groupBy(*keys).agg(cuts)
    if hot is None:
        order = Window.partitionBy(*keys).orderBy(F.col("value").desc())
        return counts.withColumn("better", F.sum("ties").over(order) - F.col("ties"))
    placed = _nullsafe_join(counts, hot, keys, "left").withColumn("bucket", F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("value")))).otherwise(0)).drop("cuts")
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col("value").desc())
    above = Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
    totals = placed.groupBy(*keys, "bucket").agg(F.sum("ties").alias("size"))
    totals = totals.withColumn("base", F.sum("size").over(above) - F.col("size")).drop("size")
    return _nullsafe_join(placed, totals, [*keys, "bucket"], "inner").withColumn("better", F.col("base") + F.sum("ties").over(inside) - F.col("ties")).drop("bucket", "base")


def borda(df: DataFrame, group: Sequence[str], item: str, scores: Mapping[str, float], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Weighted Borda points of the rows of each group, higher scores being better.

    scores maps columns to weights. For each score the result has better_<score> (rows of the group strictly better; a
    missing score is worse than any value) and rank_<score> (competition rank, ties averaged; a missing score gets the
    middle of all ranks). points = sum of weight * (rows - rank); the order is points, then item. Equal rows count once, NULL groups form a
    group, an empty table gives no row, NaN is missing. Other columns of df are dropped.
    """
    types = dict(df.dtypes)
    rows = df.select(*group, item, *(usable(s, types[s]).alias(s) for s in scores)).distinct()
    rows = cut(rows)
    long = rows.select(*group, F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores))).alias("x")).select(*group, "x.*")
    ranks = value_ranks(long, group, bucket_rows)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("rows"), *(F.count(s).alias(f"n_{s}") for s in scores))
    out = _nullsafe_join(rows, sizes, group, "inner")
    for s in scores:
        own = ranks.filter(F.col("score") == s).select(*group, F.col("value").alias(s), F.col("ties").alias(f"ties_{s}"), F.col("better").alias(f"better_{s}"))
        out = _nullsafe_join(out, own, group, "left", s)
        out = out.withColumn(f"better_{s}", F.coalesce(f"better_{s}", f"n_{s}"))
        rank = F.when(F.col(s).isNull(), (F.col("rows") + 1) / 2).otherwise(F.col(f"better_{s}") + (F.col(f"ties_{s}") + 1) / 2)
        out = out.withColumn(f"rank_{s}", rank)
    points = reduce(lambda a, b: a + b, (F.lit(float(w)) * (F.col("rows") - F.col(f"rank_{s}")) for s, w in scores.items()))
    return out.select(*group, item, *scores, *(f"better_{s}" for s in scores), *(f"rank_{s}" for s in scores), "rows", points.alias("points"))


def _nullsafe_join(left: DataFrame, right: DataFrame, group: Sequence[str], how: str, value: str | None = None) -> DataFrame:
    """Join on group columns, NULL meeting NULL, and on value where it is not NULL."""
    right = right.select(*(F.col(c).alias(f"__r_{c}") if c in (*group, value) else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, [left[g].eqNullSafe(right[f"__r_{g}"]) for g in group] + ([left[value] == right[f"__r_{value}"]] if value else []))
    return left.join(right, on, how).drop(*(f"__r_{g}" for g in group), *([f"__r_{value}"] if value else []))


def ranking(points: DataFrame, group: Sequence[str], item: str, k: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """place in each group by points, ties broken by item; with k only the first k, found without ordering the rest.

    The whole ranking adds up counts: the rows of better points, found as ranks of a score are, and the place among equal
    points, numbered inside stretches of item. So a group that holds a third of all rows is ordered by many tasks. Items
    that are no whole numbers are numbered within equal points in one piece.
    """
    if k is not None:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("points").desc(), F.col(item).asc()))
        return points.withColumn("place", place).filter(F.col("place") <= k)
    points = cut(points)
    ranks = value_ranks(points.select(*group, F.lit("points").alias("score"), F.col("points").alias("value")), group, bucket_rows)
    whole = dict(points.dtypes)[item] in ("tinyint", "smallint", "int", "bigint")
    placed = points.withColumn("__cut", F.floor(F.col(item) / STRETCH) if whole else F.lit(0).cast("long"))
    keys = [*group, "points", "__cut"]
    before = Window.partitionBy(*group, "points").orderBy("__cut")
    base = placed.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__base", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    placed = placed.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(item)))
    joined = _nullsafe_join(_nullsafe_join(placed, base, keys, "inner"), ranks.select(*group, F.col("value").alias("points"), "better"), group, "inner", "points")
    return joined.withColumn("place", F.col("better") + F.col("__base") + F.col("__in")).drop("__cut", "__in", "__base", "better")
