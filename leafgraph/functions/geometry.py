"""Bounding-box arithmetic as column expressions (all JVM-side, inside codegen)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Left, top, right and bottom columns of a box."""

    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in "ltrb"))

    @property
    def width(self) -> Column:
        return F.greatest(self.r - self.l, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.b - self.t, F.lit(0.0))

    @property
    def cx(self) -> Column:
        return (self.l + self.r) / 2

    @property
    def cy(self) -> Column:
        return (self.t + self.b) / 2

    @property
    def area(self) -> Column:
        return self.width * self.height


#: Added before rounding, so that a tie goes up whatever its last bits are.
TIE = 1e-9


def rounded(c: Column, digits: int = 4) -> Column:
    return F.round(c + TIE, digits)


def h_overlap(x: Box, y: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(x.r, y.r) - F.greatest(x.l, y.l))


def v_overlap(x: Box, y: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(x.b, y.b) - F.greatest(x.t, y.t))


def ratio(part: Column, base: Column) -> Column:
    """part / base, and 0 where the base isn't positive."""
    return F.when(base > 0, part / base).otherwise(F.lit(0.0))


def h_ratio(x: Box, y: Box) -> Column:
    return ratio(h_overlap(x, y), F.least(x.width, y.width))


def v_ratio(x: Box, y: Box) -> Column:
    return ratio(v_overlap(x, y), F.least(x.height, y.height))


def v_gap(x: Box, y: Box) -> Column:
    return F.when(y.t >= x.b, y.t - x.b).when(x.t >= y.b, x.t - y.b).otherwise(F.lit(0.0))


def h_gap(x: Box, y: Box) -> Column:
    return F.greatest(F.lit(0.0), y.l - x.r, x.l - y.r)


def mean_height(x: Box, y: Box) -> Column:
    """Mean of two heights, one at least."""
    return F.greatest((x.height + y.height) / 2, F.lit(1.0))


def intersection(x: Box, y: Box) -> Column:
    return h_overlap(x, y) * v_overlap(x, y)


def cover(x: Box, y: Box) -> Column:
    """The share of ``x`` that lies in ``y``."""
    return ratio(intersection(x, y), x.area)


def alignment(x: Box, y: Box) -> Column:
    widest = F.greatest(x.width, y.width, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x.cx - y.cx) / widest)


def spatial_score(x: Box, y: Box) -> Column:
    """Nearness of a chunk and a region: shared area, or overlap and alignment damped by the gap."""
    near = (F.lit(0.65) * h_ratio(x, y) + F.lit(0.35) * alignment(x, y)) / (F.lit(1.0) + v_gap(x, y) / mean_height(x, y))
    return F.least(F.lit(1.0), F.greatest(ratio(intersection(x, y), F.least(x.area, y.area)), near))


def height_similarity(x: Box, y: Box) -> Column:
    return F.least(x.height, y.height) / F.greatest(x.height, y.height, F.lit(1.0))


def centre_distance(x: Box, y: Box) -> Column:
    return F.hypot(x.cx - y.cx, x.cy - y.cy)


def union(prefix: str = "") -> list[Column]:
    """Aggregates of the box around all boxes of a group."""
    return [F.min(f"{prefix}l").alias("l"), F.min(f"{prefix}t").alias("t"), F.max(f"{prefix}r").alias("r"), F.max(f"{prefix}b").alias("b")]


def from_polygon(points: Column) -> list[Column]:
    """The box around a polygon x, y, x, y, ...; null unless it has four points or more, in pairs."""
    good = (F.size(points) >= 8) & (F.size(points) % 2 == 0)
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    return [F.when(good, f(v)).alias(n) for n, f, v in (("l", F.array_min, xs), ("t", F.array_min, ys), ("r", F.array_max, xs), ("b", F.array_max, ys))]


def to_pixels(bbox: Column, width: Column, height: Column) -> list[Column]:
    """Pixels of a box given as shares of the page."""
    left, top = bbox["Left"] * width, bbox["Top"] * height
    return [left.alias("l"), top.alias("t"), (left + bbox["Width"] * width).alias("r"), (top + bbox["Height"] * height).alias("b")]


def clamped(x: Box, width: Column, height: Column) -> Box:
    """A box cut to its page; the caller drops those without area."""
    zero = F.lit(0.0)
    return Box(F.greatest(zero, x.l), F.greatest(zero, x.t), F.least(width, x.r), F.least(height, x.b))


def polygon_points(points: Column) -> Column:
    """The corners of a polygon x, y, x, y, ... as structs; null unless it has four or more, in pairs."""
    good = (F.size(points) >= 8) & (F.size(points) % 2 == 0)
    corners = F.transform(F.sequence(F.lit(0), F.size(points) - 2, F.lit(2)), lambda i: F.struct(F.get(points, i).alias("x"), F.get(points, i + 1).alias("y")))
    return F.when(good, corners)


def polygon_anchor(points: Column) -> list[Column]:
    """The left-most x and the top-most y of a polygon."""
    left, top, _, _ = from_polygon(points)
    return [left.alias("x"), top.alias("y")]


def slot(x: Box, modality: Column, count: Column, index: Column) -> Box:
    """The box of the ``index``-th of ``count`` sentences: its share of the parent's height; patches keep their own."""
    n = F.greatest(F.lit(1), count)
    i = F.greatest(F.lit(0), F.least(index, n - 1))
    share = x.height / n
    own = modality == "patch"
    top = F.when(own, x.t).otherwise(x.t + i * share)
    return Box(x.l, top, x.r, F.when(own | (i == n - 1), x.b).otherwise(top + share))
