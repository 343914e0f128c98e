"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vec_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def vec_div(a: Column, n: Column) -> Column:
    return F.transform(a, lambda x: x / n)


def vec_norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; an error for unequal sizes, null if a vector is zero."""
    score = vec_dot(a, b) / F.nullif(vec_norm(a) * vec_norm(b), F.lit(0.0))
    unequal = F.raise_error(F.lit("cosine: vectors of unequal size")).cast("double")
    return F.when(F.size(a) == F.size(b), score).otherwise(unequal)


def scaled_dot(a: Column, b: Column) -> Column:
    """Dot product over the product of the two dimension counts."""
    return vec_dot(a, b) / (F.size(a) * F.size(b)).cast("double")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
