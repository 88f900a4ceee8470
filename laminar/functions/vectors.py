"""Vector functions on array<double> columns, and the same on numpy arrays for folds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def fused(embedding: Column, colour: Column, weight: float) -> Column:
    """Both parts normalised and weighted so that their squared lengths are 1 - weight and weight; without a weight, the embedding as it is."""
    if weight <= 0:
        return embedding
    a, b = math.sqrt(1 - weight), math.sqrt(weight)
    return F.concat(F.transform(normalised(embedding), lambda x: x * F.lit(a)), F.transform(normalised(colour), lambda x: x * F.lit(b)))


def running_mean(centroid: Column, count: Column, v: Column) -> Column:
    return F.zip_with(centroid, v, lambda c, x: (c * count + x) / (count + 1))


def intersection(a: Column, b: Column) -> Column:
    """Shared part of two histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero, so that their cosine with anything is 0."""
    m = np.asarray(m, np.float64)
    n = np.sqrt((m * m).sum(axis=-1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)
