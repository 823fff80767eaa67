"""Rectangles (x0, y0, x1, y1 with the origin at the top left) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def inside(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """a lies within b."""
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def centre_inside(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def to_points(px: Column, dpi: Column, offset: Column) -> Column:
    """Pixels of a rendered clip to page points."""
    return px * 72.0 / dpi + offset
