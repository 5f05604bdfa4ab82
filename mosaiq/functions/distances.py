"""Distances of two array columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]


def total(a: Column, b: Column, f: Pair) -> Column:
    """Sum of f over the components of both."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1.0 / p))


def weighted_minkowski(a: Column, b: Column, weights: list[float], p: float) -> Column:
    w = F.array(*map(F.lit, weights))
    powers = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p)))
    return F.pow(total(powers, w, lambda x, y: x * y), F.lit(1.0 / p))


def standardised_euclidean(a: Column, b: Column, variances: list[float]) -> Column:
    v = F.array(*map(F.lit, variances))
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), v, lambda x, y: F.when(y > 0, x / y).otherwise(0.0)))


def mahalanobis(a: Column, b: Column, inverse: list[list[float]]) -> Column:
    """With the inverse of a covariance matrix."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    moved = F.array(*[total(F.array(*map(F.lit, row)), d, lambda x, y: x * y) for row in inverse])
    return F.sqrt(total(moved, d, lambda x, y: x * y))


def canberra(a: Column, b: Column) -> Column:
    return total(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0))


def bray_curtis(a: Column, b: Column) -> Column:
    top, bottom = total(a, b, lambda x, y: F.abs(x - y)), total(a, b, lambda x, y: F.abs(x + y))
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for two zero vectors, 1 if just one is zero."""
    na, nb = total(a, a, lambda x, y: x * y), total(b, b, lambda x, y: x * y)
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - total(a, b, lambda x, y: x * y) / F.sqrt(na * nb))


def correlation(a: Column, b: Column) -> Column:
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = lambda v: F.transform(v, lambda x: x - mean(v))
    return cosine(centred(a), centred(b))


def _counts(a: Column, b: Column, eps: float) -> tuple[Column, Column, Column]:
    hit = lambda f: total(a, b, lambda x, y: F.when(f(x >= eps, y >= eps), 1.0).otherwise(0.0))
    return hit(lambda x, y: x & y), hit(lambda x, y: x & ~y), hit(lambda x, y: ~x & y)


def jaccard(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """On components of eps or more; 0 if none is."""
    both, left, right = _counts(a, b, eps)
    return F.when(both + left + right > 0, (left + right) / (both + left + right)).otherwise(0.0)


def dice(a: Column, b: Column, eps: float = 1e-6) -> Column:
    both, left, right = _counts(a, b, eps)
    return F.when(both + left + right > 0, (left + right) / (2 * both + left + right)).otherwise(0.0)


def categorical(a: Column, b: Column) -> Column:
    """Whether the first components differ."""
    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), 0.0).otherwise(1.0)


def ordinal(a: Column, b: Column, support: float) -> Column:
    return F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) / support


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
