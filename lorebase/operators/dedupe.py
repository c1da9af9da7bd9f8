"""Messages delivered more than once: keep exactly one copy of each identifier.

Rows are partitioned by the message identifier and ranked by arrival; the first stays. ``row_number() <= 1`` is
planned as a WindowGroupLimit *before* the exchange, so every map task sends at most one row of an identifier and an
identifier that holds a third of all rows is no hot partition. Surplus rows are found by an anti-join on the row id,
which is unique and therefore cannot be skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = "__rank"


def _identified(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def first_copies(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The first row of each identifier. arrival: columns by which rows arrive, last the tie-break (unique)."""
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in arrival))
    return _identified(df, keys).withColumn(RANK, F.row_number().over(order)).filter(F.col(RANK) == 1).drop(RANK)


def surplus_rows(df: DataFrame, keys: Sequence[str], row_id: str, arrival: Sequence[str] = ()) -> DataFrame:
    """Ids of all rows but the first of each identifier. Rows with a null in keys are never surplus.

    row_id must be unique and not null: it breaks ties, and rows without it cannot be named and are left out.
    An empty table gives no row; columns other than keys, arrival and row_id are not read.
    """
    narrow = df.select(*dict.fromkeys([*keys, *arrival, row_id]))
    first = first_copies(narrow, keys, [*arrival, row_id]).select(row_id)
    return _identified(narrow, keys).select(row_id).filter(F.col(row_id).isNotNull()).join(first, row_id, "left_anti")


def deduplicated(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """All rows without the surplus copies; rows that lack an identifier all stay, in their original form."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return first_copies(df, keys, arrival).unionByName(df.filter(missing))


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Rows of a batch whose identifier is not stored yet, one copy each; rows without an identifier pass."""
    fresh = deduplicated(batch, keys, arrival)
    return fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*batch.columns)
