"""Rectangles as Column arithmetic; y grows downward, a rectangle is given by its column prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(p: str) -> Column:
    return F.col(f"{p}x1") - F.col(f"{p}x0")


def height(p: str) -> Column:
    return F.col(f"{p}y1") - F.col(f"{p}y0")


def area(p: str) -> Column:
    return F.greatest(width(p), F.lit(0.0)) * F.greatest(height(p), F.lit(0.0))


def x_shared(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))


def y_shared(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))


def x_overlaps(a: str, b: str, ratio: float = 0.1) -> Column:
    return x_shared(a, b) > ratio * F.least(width(a), width(b))


def x_inside(a: str, zone: str, ratio: float = 0.6) -> Column:
    return F.when(width(a) > 0, x_shared(a, zone) / width(a) >= ratio).otherwise(False)


def in_zone(a: str, zone: str) -> Column:
    return (y_shared(a, zone) > 0.5 * height(a)) & x_overlaps(a, zone)


def union(p: str = "", to: str = "") -> list[Column]:
    """Aggregates of the smallest rectangle around a group's rectangles."""
    return [F.min(f"{p}x0").alias(f"{to}x0"), F.min(f"{p}y0").alias(f"{to}y0"), F.max(f"{p}x1").alias(f"{to}x1"), F.max(f"{p}y1").alias(f"{to}y1")]


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision over the shorter length, 0 for a zero vector. Each vector's own norm counts all its components."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
