"""Geometry on boxes (x, y, w, h) and corners (x1, y1, x2, y2), as Column expressions: no UDF, all inside code generation.

A box is a struct column with double fields x, y, w, h; a point a struct with x, y.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(v: float) -> Column:
    return F.lit(float(v))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def center(b: Column) -> Column:
    return point(b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def contains(b: Column, p: Column) -> Column:
    """Closed on all four edges."""
    return p["x"].between(b["x"], b["x"] + b["w"]) & p["y"].between(b["y"], b["y"] + b["h"])


def distance(a: Column, b: Column) -> Column:
    """Euclidean; written out, as hypot() rounds differently between engines."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees between two vectors, 0 to 180; 180 if either is zero."""
    nu, nv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    zero = (nu == 0) | (nv == 0)
    cosine = (ux * vx + uy * vy) / F.when(zero, num(1)).otherwise(nu * nv)
    return F.when(zero, num(180)).otherwise(F.degrees(F.acos(F.greatest(num(-1), F.least(num(1), cosine)))))


def y_overlap(a: Column, b: Column) -> Column:
    """Vertical overlap as a share of the lower of the two heights; 0 if that is not positive."""
    low = F.least(a["h"], b["h"])
    over = F.greatest(num(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return F.when(low > 0, over / F.when(low > 0, low)).otherwise(num(0))


def head_crop(b: Column, top: float = 0.45, width: float = 0.7) -> Column:
    """The top share of a figure's box, narrowed around its vertical axis."""
    w = b["w"] * num(width)
    return box(b["x"] + (b["w"] - w) / 2, b["y"], w, b["h"] * num(top))


def int_box(b: Column) -> Column:
    """Pixel corners: each of x, y, w, h cut towards zero, then added."""
    x, y, w, h = (b[k].cast("int") for k in "xywh")
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def int_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


def clamped(c: Column, width: Column, height: Column) -> Column:
    """Corners cut to an image's extent."""
    zero = F.lit(0)
    return F.struct(
        F.least(F.greatest(zero, c["x1"]), width).alias("x1"), F.least(F.greatest(zero, c["y1"]), height).alias("y1"),
        F.greatest(zero, F.least(c["x2"], width)).alias("x2"), F.greatest(zero, F.least(c["y2"], height)).alias("y2"),
    )


def is_empty(c: Column) -> Column:
    return (c["x2"] <= c["x1"]) | (c["y2"] <= c["y1"])


def upscaled(w: Column, h: Column, least: int = 28) -> Column:
    """(w, h) scaled so that the lower side has `least` pixels; half is rounded to even. Unchanged if it has them."""
    low = F.least(w, h)
    scale = num(least) / F.when(low > 0, low.cast("double"))
    grow = lambda s: F.greatest(F.lit(least), F.bround(s * scale).cast("int"))
    return F.struct(F.when(low < least, grow(w)).otherwise(w).alias("w"), F.when(low < least, grow(h)).otherwise(h).alias("h"))


def decay(value: Column, limit: Column) -> Column:
    """1 at 0, falling linearly to 0 at the limit and beyond."""
    return F.greatest(num(0), num(1) - value / limit)


def diagonal(w: Column, h: Column) -> Column:
    return F.sqrt(w * w + h * h)
