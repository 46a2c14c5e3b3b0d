"""Expressions on array<float> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pairs(a, b, f) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance: what a flat index returns."""
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def dot(a: Column | str, b: Column | str) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalised(a: Column | str) -> Column:
    n = norm(a) + F.lit(1e-12)
    return F.transform(_c(a), lambda x: (x.cast("double") / n).cast("float"))


def fixed_length(a: Column | str, dim: int) -> Column:
    """Cut or padded with zeros to dim numbers."""
    return F.slice(F.concat(_c(a), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def usable(a: Column | str, dim: int) -> Column:
    """Not null, of the right length, finite and not all zero."""
    ok = F.forall(_c(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(_c(a)) == dim) & ok & (norm(a) > 0), F.lit(False))


def score(distance: Column | str) -> Column:
    """Similarity of a squared distance of unit vectors, never negative."""
    return F.greatest(F.lit(0.0), 1 - _c(distance) / 2)


def federated_score(distance: Column | str) -> Column:
    """The unclamped form of the federated path, one half where the distance is absent or zero."""
    d = _c(distance)
    return F.when(d.isNull() | (d == 0), F.lit(0.5)).otherwise(1 - d / 2)
