"""Vector checks and cosine measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_error(c: Column, width: int) -> Column:
    """Null for a usable vector, else the reason it is refused."""
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (F.when(c.isNull(), F.lit("missing"))
            .when(F.size(c) != width, F.lit("dimension"))
            .when(bad, F.lit("non_finite")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a side has no direction."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.lit(1.0) - dot(a, b) / size)


def similarity(distance: Column) -> Column:
    """1 - distance, kept inside -1..1, six decimals."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - distance)), 6)
