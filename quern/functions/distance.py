"""Vector distances as Column expressions, computed in DOUBLE.

A null vector gives null.  Vectors of different lengths give null, as no distance
is defined between them.  A vector without length has similarity 0 to all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(as_double(v), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a| |b|), 0 where either norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Lower is nearer for every metric: the dot product is negated."""
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return l2(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def normalize(v: Column) -> Column:
    """v / |v|; a vector without length stays as it is."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def round6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def problem(id_: Column, v: Column, dimension: int) -> Column:
    """What bars a vector from a collection: id, empty, dimension or value (not a number, or beyond 3.4e38); null if nothing."""
    large = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4e38))
    return F.when(id_.isNull() | (id_ == ""), "id").when(v.isNull() | (F.size(v) == 0), "empty").when(large, "value").when(F.size(v) != dimension, "dimension")
