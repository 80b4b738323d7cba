"""Body-line geometry on an array<struct<x, y>> column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complete(points: Column) -> Column:
    return points.isNotNull() & F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def skeleton_length(points: Column, n: int = 49) -> Column:
    """Sum of segment lengths; NULL when any coordinate is missing."""
    seg = F.zip_with(F.slice(points, 2, n - 1), F.slice(points, 1, n - 1),
                     lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.when(complete(points), F.aggregate(seg, F.lit(0.0), lambda s, v: s + v))


def head_angle(points: Column) -> Column:
    """Signed angle from (p0 - p5) to (p20 - p30)."""
    def at(i, c):
        return F.get(points, F.lit(i))[c]

    hx, hy = at(0, "x") - at(5, "x"), at(0, "y") - at(5, "y")
    bx, by = at(20, "x") - at(30, "x"), at(20, "y") - at(30, "y")
    return F.when(complete(points), F.atan2(hx * by - hy * bx, hx * bx + hy * by))
