"""Dense positions and neighbour windows that never order a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def dense_ordinals(df: DataFrame, group: Sequence[str], order: str, name: str = "ordinal", width: int = WIDTH) -> DataFrame:
    """Adds name: 0, 1, 2 ... within each group by the whole-number column order (unique in the group).

    Rows are numbered inside stretches of width values of order; the sizes of the stretches before are added. A group
    of any size is spread over as many tasks as it has stretches.
    """
    cut = F.floor(F.col(order) / width)
    placed = df.withColumn("__cut", cut)
    sizes = placed.groupBy(*group, "__cut").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cut")
    base = sizes.withColumn("__base", F.sum("__n").over(before) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*group, "__cut").orderBy(order)) - 1
    return placed.withColumn("__in", inside).join(base, [*group, "__cut"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__cut", "__in", "__base")


def context_rows(rows: DataFrame, hits: DataFrame, group: str, ordinal: str, reach: int = 2) -> DataFrame:
    """Rows at most reach places from a hit, with hit_ordinal; an equi join on the exploded places, no range scan."""
    wanted = hits.select(group, F.col(ordinal).alias("hit_ordinal"), F.explode(F.sequence(F.greatest(F.col(ordinal) - reach, F.lit(0).cast("long")), F.col(ordinal) + reach)).alias(ordinal))
    return wanted.join(rows, [group, ordinal])


def running_sum(df: DataFrame, group: Sequence[str], order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds name: the sum of the whole-number column value over this and all earlier rows of the group, by stretches."""
    placed = df.withColumn("__cut", F.floor(F.col(order) / width))
    sums = placed.groupBy(*group, "__cut").agg(F.sum(value).alias("__s"))
    base = sums.withColumn("__base", F.sum("__s").over(Window.partitionBy(*group).orderBy("__cut")) - F.col("__s")).drop("__s")
    inside = F.sum(value).over(Window.partitionBy(*group, "__cut").orderBy(order))
    return placed.withColumn("__in", inside).join(base, [*group, "__cut"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__cut", "__in", "__base")


def previous(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Adds prev_<column>: the value in the row before, across stretches, NULL in a group's first row."""
    placed = df.withColumn("__cut", F.floor(F.col(order) / width))
    row = F.struct(*columns)
    last = placed.groupBy(*group, "__cut").agg(F.max_by(row, order).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*group).orderBy("__cut"))).drop("__last")
    inside = F.lag(row).over(Window.partitionBy(*group, "__cut").orderBy(order))
    joined = placed.withColumn("__p", inside).join(before, [*group, "__cut"]).withColumn("__p", F.coalesce("__p", "__before"))
    return joined.withColumns({f"prev_{c}": F.col("__p")[c] for c in columns}).drop("__p", "__before", "__cut")
