"""Vector functions over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine over the common length; 0 if a norm is 0."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(_dot(a, b), norms))
