"""Vector functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def rms_difference(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, d) / F.size(a))


def peak_to_peak(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def energy(a: Column) -> Column:
    return dot(a, a)
