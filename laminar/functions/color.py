"""Hue histograms of saturated, mid-brightness pixels, from pixel rows or from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 16
MIN_SATURATION, MIN_VALUE, MAX_VALUE = 60, 40, 250


def colourful(s: Column, v: Column) -> Column:
    return (s > MIN_SATURATION) & (v > MIN_VALUE) & (v < MAX_VALUE)


def hue_bin(h: Column, bins: int = BINS) -> Column:
    """Equal bins over 0 to 255, the last one closed."""
    return F.least(F.lit(bins - 1), F.floor(h * F.lit(bins) / F.lit(255.0)).cast("int"))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """8-bit hue, saturation, value of 8-bit colours, cut to integers."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = top - low
    d = F.when(span > 0, span).otherwise(F.lit(1.0))
    rc, gc, bc = ((top - c) / d for c in (r, g, b))
    h = F.when(r == top, bc - gc).when(g == top, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    turn = F.pmod(h / 6.0 + 1.0, F.lit(1.0))
    return F.struct(
        F.when(span > 0, (turn * 255.0).cast("int")).otherwise(0).alias("h"), F.when(top > 0, (span / F.when(top > 0, top) * 255.0).cast("int")).otherwise(0).alias("s"), top.cast("int").alias("v")
    )


def histogram(pixels: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """pixels(keys, h, s, v) -> keys, hist: shares by bin that sum to 1, zeros if no pixel qualifies.

    One aggregation with a conditional count a bin: combined map-side, `bins` numbers a key in the shuffle, no dense grid to join.
    """
    use, at = colourful(F.col("s"), F.col("v")), hue_bin(F.col("h"), bins)
    counts = pixels.groupBy(*keys).agg(*[F.count_if(use & (at == i)).alias(f"b{i}") for i in range(bins)])
    counts = counts.select(*keys, F.array(*[F.col(f"b{i}") for i in range(bins)]).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.select(*keys, F.transform("n", lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))).alias("hist"))
