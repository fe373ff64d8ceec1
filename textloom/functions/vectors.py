"""Vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, epsilon: float = 1e-6) -> Column:
    return F.transform(a, lambda x: x / (norm(a) + epsilon))


def mean(a: Column, dims: int, weight: Column | None = None) -> Column:
    """Aggregate: the weighted mean of vectors of ``dims`` numbers, as plain sums, which tasks combine in place before rows are shuffled."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(w * F.get(a, F.lit(k)).cast("double")) / F.sum(w) for k in range(dims)])
