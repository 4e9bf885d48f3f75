"""Vector columns over ``array<float>`` or ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a norm is 0; an error when the lengths differ."""
    lengths = norm(a) * norm(b)
    value = F.when(lengths == 0, 0.0).otherwise(dot(a, b) / F.nullif(lengths, F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double"))
