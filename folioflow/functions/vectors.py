"""Dense and sparse vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def unit(a: Column) -> Column:
    """The vector at length 1; zero vectors stay as they are."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))
