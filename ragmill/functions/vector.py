"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is empty or zero or the lengths differ."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    both = norm(a) * norm(b)
    return F.when(usable & (both > 0), dot(a, b) / both).otherwise(F.lit(0.0))
