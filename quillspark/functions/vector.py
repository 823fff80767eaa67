"""Vectors as arrays: dot product, norm and the checks of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def problems(a: Column, dims: int) -> Column:
    """What is wrong with a stored vector."""
    return F.array_compact(
        F.array(
            F.when(F.size(a) != dims, "dimension"),
            F.when(F.exists(a, lambda x: F.isnan(x) | x.isNull()), "not finite"),
            F.when(F.abs(norm(a) - 1) > 1e-3, "norm"),
        )
    )
