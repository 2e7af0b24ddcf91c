"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Unit length; vectors shorter than 1e-8 stay."""
    size = norm(a)
    return F.transform(a, lambda x: x / F.when(size < 1e-8, F.lit(1.0)).otherwise(size))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def times_matrix(a: Column, matrix: list[list[float]]) -> Column:
    """Row vector times a small constant matrix, as literal sums."""
    columns = list(zip(*matrix))
    return F.array(*[sum((F.get(a, k) * F.lit(float(w)) for k, w in enumerate(c)), F.lit(0.0)) for c in columns])


def mean_vector(a: Column, width: int) -> Column:
    """Aggregate: element-wise mean over a group."""
    return F.array(*[F.avg(F.get(a, k)) for k in range(width)])
