"""Vector functions as Column expressions; Spark has no vector type, so vectors are arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """1 - cosine, in double. Null if a vector is null, has a null component or is all zero; an error if lengths differ."""
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    product = F.when(a.isNotNull() & b.isNotNull(), same)
    return F.lit(1.0) - F.try_divide(product, (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm))
