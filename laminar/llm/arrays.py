"""Column builders over arrays of words: hashed windows by doubling, repeated windows, covered words. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def doubled(h: Column, span: int) -> Column:
    """Hashes of windows of 2 x span words, from those of span words: pairs (i, i + span)."""
    n = F.size(h) - span
    left = F.slice(h, 1, F.greatest(n, F.lit(0)))
    return F.zip_with(left, F.slice(h, span + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def with_repeated(df: DataFrame, keys: str, out: str) -> DataFrame:
    """Adds `out`: positions, ascending, of the elements of `keys` that occur twice or more; null if there are none.

    One sort, no comparison of all with all. Every step is a projection of its own, so that none is computed more than once.
    """
    k = F.col(keys)
    some = F.size(F.array_distinct(k)) < F.size(k)
    numbered = F.zip_with(k, F.sequence(F.lit(0), F.size(k) - 1), lambda x, i: F.struct(x.alias("k"), i.alias("i")))
    df = df.select("*", F.when(some, F.sort_array(numbered)).alias("_pairs"))
    # equal to the next one; a pair repeats if it equals the next one or the one before
    df = df.select("*", F.zip_with("_pairs", F.slice("_pairs", 2, F.size("_pairs")), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False))).alias("_same"))
    df = df.select("*", F.zip_with("_same", F.concat(F.array(F.lit(False)), F.slice("_same", 1, F.size("_same") - 1)), lambda a, b: a | b).alias("_either"))
    marked = F.zip_with("_pairs", "_either", lambda p, e: F.when(e, p["i"]))
    return df.select("*", F.sort_array(F.array_compact(marked)).alias(out)).drop("_pairs", "_same", "_either")


def covered(starts: Column, span: int) -> Column:
    """How many positions lie in the windows of `span` that begin at `starts` (ascending)."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(span)), F.lit(span)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)
