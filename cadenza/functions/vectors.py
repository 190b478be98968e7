"""Vectors as arrays of numbers, with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def unit(v: Column | str) -> Column:
    """The vector of length 1; null where the length is 0."""
    return let(doubles(v), lambda d: let(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a length is 0."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))


def angle(a: Column | str, b: Column | str) -> Column:
    """Angular distance as a share of a half turn."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / F.lit(3.141592653589793)


def mean_vector(v: Column | str, width: int, weight: Column | None = None) -> Column:
    """Aggregate: the (weighted) mean of vectors of a known width, one sum for each place."""
    d, w = doubles(v), F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(F.get(d, i) * w) / F.sum(w) for i in range(width)])


def lower_median(values: Column) -> Column:
    """Of an array: of an even number the lower one of the middle pair."""
    return let(F.sort_array(values), lambda s: F.element_at(s, F.greatest(F.lit(1), F.floor((F.size(s) + 1) / 2).cast("int"))))


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest of an array, or of all where there are fewer."""
    return let(F.slice(F.sort_array(values, False), 1, k), lambda s: total(s) / F.size(s))
