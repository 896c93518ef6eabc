"""Numeric column helpers. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e**x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(score: Column, label: Column) -> Column:
    return softplus(score) - label * score


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
