"""Vector expressions in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a literal vector, whose norm is folded on the driver; null for a zero vector."""
    length = sum(x * x for x in query) ** 0.5
    v = doubles(vector)
    size = norm(v) * length
    return F.when(size > 0, dot(v, F.array(*map(F.lit, map(float, query)))) / size)


def l2_normalized(vector: Column) -> Column:
    """The vector divided by its norm; as it is where the norm is 1e-12 or less."""
    v = doubles(vector)
    n = norm(v)
    return F.when(n > 1e-12, F.transform(v, lambda x: x / n)).otherwise(v)
