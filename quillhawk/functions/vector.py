"""Vector arithmetic as Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def squared_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_sum(v))


def same_shape(a: Column, b: Column, value: Column) -> Column:
    """``value`` if both arrays have one length, else an error: pairing would silently pad with nulls."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors must have the same length")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return same_shape(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(same_shape(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def similarity_from_distance(d: Column) -> Column:
    """1 - d*d/2, not below 0, to four places: the cosine if both vectors have unit length."""
    return F.round(F.greatest(F.lit(0.0), 1 - d * d / 2), 4)


def root_descriptor(v: Column) -> Column:
    """Square roots of a descriptor's shares of its sum."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x: F.sqrt(x / (total + F.lit(1e-7))))


def weighted_concat(a: Column, b: Column, weight_a: float = 0.6, weight_b: float = 0.4) -> Column:
    return F.concat(F.transform(a, lambda x: x * F.lit(weight_a)), F.transform(b, lambda x: x * F.lit(weight_b)))


def vector_literal(v: Column) -> Column:
    """``[x,...]`` with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x)), ","), F.lit("]"))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); an empty range divides by 1."""
    return (x - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
