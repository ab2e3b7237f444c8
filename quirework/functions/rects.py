"""Rectangle algebra (B10) on structs of four doubles x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(SIDES, (x0, y0, x1, y1))))


def rect_of(prefix: str = "") -> Column:
    """The rectangle made of the four plain columns, optionally with a name prefix."""
    return rect(*(F.col(prefix + s) for s in SIDES))


def spread(r: Column, prefix: str = "") -> list[Column]:
    """The four sides as separate columns."""
    return [r.getField(s).alias(prefix + s) for s in SIDES]


def width(r: Column) -> Column:
    return r.getField("x1") - r.getField("x0")


def height(r: Column) -> Column:
    return r.getField("y1") - r.getField("y0")


def area(r: Column) -> Column:
    return width(r) * height(r)


def rect_union(a: Column, b: Column) -> Column:
    return rect(
        F.least(a.getField("x0"), b.getField("x0")),
        F.least(a.getField("y0"), b.getField("y0")),
        F.greatest(a.getField("x1"), b.getField("x1")),
        F.greatest(a.getField("y1"), b.getField("y1")),
    )


def rect_intersection(a: Column, b: Column) -> Column:
    """May come out inverted when the two do not meet; test with ``is_valid``."""
    return rect(
        F.greatest(a.getField("x0"), b.getField("x0")),
        F.greatest(a.getField("y0"), b.getField("y0")),
        F.least(a.getField("x1"), b.getField("x1")),
        F.least(a.getField("y1"), b.getField("y1")),
    )


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(rect_intersection(a, b)))


def overlap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), height(rect_intersection(a, b)))


def overlaps(a: Column, b: Column) -> Column:
    """Positive common area."""
    return (overlap_x(a, b) > 0) & (overlap_y(a, b) > 0)


def near(a: Column, b: Column, gap: float = 12.0) -> Column:
    return ~(
        (a.getField("x1") + gap < b.getField("x0"))
        | (b.getField("x1") + gap < a.getField("x0"))
        | (a.getField("y1") + gap < b.getField("y0"))
        | (b.getField("y1") + gap < a.getField("y0"))
    )


def center_x(r: Column) -> Column:
    return (r.getField("x0") + r.getField("x1")) / 2


def center_y(r: Column) -> Column:
    return (r.getField("y0") + r.getField("y1")) / 2


def center_inside(inner: Column, outer: Column) -> Column:
    """Centre of ``inner`` within ``outer``; left and top edges count, right and bottom do not."""
    cx, cy = center_x(inner), center_y(inner)
    return (
        (cx >= outer.getField("x0")) & (cx < outer.getField("x1"))
        & (cy >= outer.getField("y0")) & (cy < outer.getField("y1"))
    )


def pad_and_clamp(r: Column, page: Column, padding: float, bottom: Column) -> Column:
    """Grow by ``padding`` inside the page, never below ``bottom``."""
    return rect(
        F.greatest(page.getField("x0"), r.getField("x0") - padding),
        F.greatest(page.getField("y0"), r.getField("y0") - padding),
        F.least(page.getField("x1"), r.getField("x1") + padding),
        F.least(bottom, r.getField("y1") + padding),
    )


def big_enough(r: Column, min_width: float = 18.0, min_height: float = 10.0) -> Column:
    return (width(r) >= min_width) & (height(r) >= min_height)
