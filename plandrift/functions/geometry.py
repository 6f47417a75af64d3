"""Geometry on boxes (x0, y0, x1, y1) in the page's unit square, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return [F.col(f"{prefix}{v}{suffix}") for v in ("x0", "y0", "x1", "y1")]


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def normalise(b: Box, width: Column, height: Column, from_bottom: bool = False) -> list[Column]:
    """A box in page units, in the unit square from the top left; zeros for a page without extent."""
    x0, y0, x1, y1 = b
    if from_bottom:
        y0, y1 = height - y1, height - y0
    low, high = (lambda a, c: F.least(a, c)), (lambda a, c: F.greatest(a, c))
    sized = (width > 0) & (height > 0)
    scaled = (low(x0, x1) / width, low(y0, y1) / height, high(x0, x1) / width, high(y0, y1) / height)
    return [F.when(sized, clamp(v)).otherwise(0.0) for v in scaled]


def denormalise(b: Box, width: Column, height: Column) -> list[Column]:
    return [b[0] * width, b[1] * height, b[2] * width, b[3] * height]


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(a: Box, b: Box) -> Column:
    """The share of the smaller box that both cover."""
    inter = intersection(a, b)
    return F.when(inter > 0, inter / F.greatest(F.lit(1e-9), F.least(area(a), area(b)))).otherwise(0.0)


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def affine(b: Box, m: Sequence[Column | float]) -> list[Column]:
    """The hull of a box's corners under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    corners = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    xs = [m[0] * x + m[1] * y + m[2] for x, y in corners]
    ys = [m[3] * x + m[4] * y + m[5] for x, y in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def pixel_affine(m: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """A pixel affine as one of the unit square."""
    return [m[0], m[1] * height / width, m[2] / width, m[3] * width / height, m[4], m[5] / height]


def plausible(m: Sequence[Column], residual: Column, most: float) -> Column:
    """Whether an affine is a plausible registration: determinant, scale and residual within bounds."""
    determinant = F.abs(m[0] * m[4] - m[1] * m[3])
    scale = F.sqrt(m[0] * m[0] + m[3] * m[3])
    return determinant.between(0.2, 5.0) & scale.between(0.5, 2.0) & (residual <= 3 * most)


def shape(a: Box, b: Box) -> Column:
    """How alike two boxes' areas are."""
    size = lambda c: F.greatest(F.lit(1e-6), c[2] - c[0]) * F.greatest(F.lit(1e-6), c[3] - c[1])
    one, two = size(a), size(b)
    return 1.0 - F.least(F.lit(1.0), F.abs(one - two) / F.greatest(one, two))
