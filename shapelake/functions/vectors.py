"""Feature vectors ``array<double>`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: (x * x).cast("double"))))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column, both_zero: float | None = None) -> Column:
    """Cosine of two vectors; null if one has no length, ``both_zero`` if given and both have none."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return value if both_zero is None else F.when((norm(a) == 0) & (norm(b) == 0), F.lit(both_zero)).otherwise(value)


def cosine_loss(a: Column, b: Column) -> Column:
    """1 - cosine, 1 if a vector has no length."""
    return F.coalesce(F.lit(1.0) - cosine(a, b), F.lit(1.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(2.0))))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference over aligned places; 0 for empty vectors."""
    return F.coalesce(F.try_divide(_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))), F.size(a)), F.lit(0.0))
