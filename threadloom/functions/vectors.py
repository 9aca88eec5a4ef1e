"""Arithmetic on array<float|double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when the lengths differ or a norm is zero."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))
