"""Column expressions over vectors (arrays of floats), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(distance: Column) -> Column:
    """Cosine similarity of a cosine distance, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or not finite."""
    both = norm(a) * norm(b)
    usable = (both > 0) & ~F.isnan(both) & (both < F.lit(float("inf")))
    return F.when(usable, dot(a, b) / both).otherwise(0.0)


def valid(a: Column, size: int) -> Column:
    """Of the expected length, every component finite."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == size) & finite, F.lit(False))


def canonical(a: Column, size: int, least: float = 1e-12) -> Column:
    """Unit vector; NULL where the vector is not valid or as good as zero."""
    length = norm(a)
    return F.when(valid(a, size) & (length >= least), F.transform(a, lambda x: x.cast("double") / length))
