"""Vector columns: arrays of double with JVM-side arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    size = F.least(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(F.when(F.size(a) == F.size(b), same).otherwise(F.slice(same, F.lit(1), size)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
