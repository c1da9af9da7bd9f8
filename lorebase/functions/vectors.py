"""Vector expressions over array<float> columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 if one has no length, NULL if one is NULL, holds a NULL, or their sizes differ."""
    lengths = norm(a) * norm(b)
    return F.when(F.size(_col(a)) == F.size(_col(b)), F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths))


def vector_literal(values: list[float]) -> Column:
    """A query vector as a constant, so that no join is needed to compare it with a column."""
    return F.array(*(F.lit(float(v)) for v in values))
