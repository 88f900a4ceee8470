"""Identities from vectors that arrive in order: assignment to clusters, centroids, matches, registry snapshots.

Assignment depends on everything assigned before in the same group (a comic and an embedding backend), so a group is one ordered stream:
rows are dealt by group, sorted by arrival within it, and folded batch by batch. A task keeps a group's members only, which complete linkage needs by definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.functions import vectors as V

THRESHOLD = 0.55
MODES = ("complete_linkage", "centroid")


class Rows:
    """Rows of a numpy array that grows at its end; the memory behind them doubles when it is full, so that adding n rows copies O(n) of them in all."""

    def __init__(self, rows: np.ndarray) -> None:
        self.held, self.n = rows, len(rows)

    @property
    def filled(self) -> np.ndarray:
        return self.held[: self.n]

    def add(self, row: np.ndarray | int) -> None:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, np.zeros((max(16, self.n), *self.held.shape[1:]), self.held.dtype)])
        self.held[self.n] = row
        self.n += 1


class Store:
    """Clusters of one group. Members are unit vectors with their cluster number, so a similarity is one matrix product."""

    def __init__(self, units: np.ndarray | None = None, of: np.ndarray | None = None, sums: np.ndarray | None = None) -> None:
        self._units = None if units is None else Rows(units)
        self._of = Rows(np.zeros(0, np.int64) if of is None else of)
        self._sums = None if sums is None else Rows(sums)

    @property
    def units(self) -> np.ndarray:
        return self._units.filled

    @property
    def of(self) -> np.ndarray:
        return self._of.filled

    @property
    def sums(self) -> np.ndarray:
        return self._sums.filled

    @property
    def next(self) -> int:
        return 0 if self._sums is None else self._sums.n

    def scores(self, v: np.ndarray, mode: str) -> np.ndarray:
        """By cluster: the least similarity to a member, or the similarity to the mean of the members."""
        if not self.next:
            return np.zeros(0)
        unit = V.unit_rows(v)
        if mode == "complete_linkage":
            out = np.full(self.next, np.inf)
            np.minimum.at(out, self.of, self.units @ unit)
            return out
        return V.unit_rows(self.sums) @ unit

    def assign(self, v: np.ndarray, threshold: float, mode: str) -> tuple[int, float, bool]:
        """(cluster, similarity, new). The best cluster, the first of equals, takes the vector if it is similar enough; a new cluster reports the best score that lost, 0 if there was none."""
        v = np.asarray(v, np.float64)
        if self._units is None:
            self._units, self._sums = Rows(np.zeros((0, len(v)))), Rows(np.zeros((0, len(v))))
        s = self.scores(v, "complete_linkage" if mode == "complete_linkage" else "centroid")
        best = int(np.argmax(s)) if len(s) else -1
        similarity = float(s[best]) if best >= 0 else 0.0
        new = best < 0 or similarity < threshold
        if new:
            best = self.next
            self._sums.add(np.zeros(len(v)))
        self._units.add(V.unit_rows(v))
        self._of.add(best)
        self.sums[best] += v
        return best, similarity, new


def assign(vectors: DataFrame, group: list[str], order: list[str], threshold: float = THRESHOLD, mode: str = "complete_linkage") -> DataFrame:
    """vectors(group, order, v) -> group, order, cluster (0-based, by creation), similarity, is_new."""
    keep = [*group, *order]
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, store = None, Store()
        for pdf in batches:
            rows = []
            for r, v in zip(pdf[keep].itertuples(index=False, name=None), pdf["v"], strict=True):
                if r[: len(group)] != now:
                    now, store = r[: len(group)], Store()
                rows.append((*r, *store.assign(v, threshold, mode)))
            yield pd.DataFrame(rows, columns=[*keep, "cluster", "similarity", "is_new"])

    dealt = vectors.select(*keep, V.doubles(F.col("v")).alias("v")).repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInPandas(fold, f"{schema}, cluster int, similarity double, is_new boolean")


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centroid: means by position, combined map-side."""
    at = vectors.select(*keys, F.posexplode(V.doubles(F.col("v"))).alias("pos", "x"))
    means = at.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return packed.select(*keys, F.transform("p", lambda s: s["x"]).alias("centroid"))


#: Copies of a block of targets, dealt to as many tasks, when one group holds most of the vectors.
SALTS = 16


def best_match(vectors: DataFrame, targets: DataFrame, group: list[str], target: str = "cluster", block: int = 2_000) -> DataFrame:
    """vectors(group, id, v), targets(group, target, centroid) -> group, id, best target (the first of equals), similarity; null and 0 without targets.

    Both sides are gathered to blocks of about `block` vectors by hash, and blocks meet by (group, block of targets, salt): no group is one key, a meeting is one matrix
    product and memory is bounded. A vector's best blocks are combined by max. Similarities count as equal where they agree in 12 decimals.
    """
    kind = targets.schema[target].dataType.simpleString()
    ids = [*group, "id"]
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ids)

    def blocks(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
        """rows(group, name, v) -> group, by, name: array, flat: their vectors one after the other."""
        packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(name, "v"))).alias("_all"))
        return packed.select(*by, F.transform("_all", lambda x: x[name]).alias(name), F.flatten(F.transform("_all", lambda x: x["v"])).alias(f"_{name}"))

    known = targets.select(*group, F.col(target).alias("t"), V.doubles(F.col("centroid")).alias("v"))
    counts = known.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).alias("_n"))
    dealt = known.join(counts, group).withColumn("_b", F.pmod(F.xxhash64("t"), F.col("_n")))
    right = blocks(dealt, "t", [*group, "_b"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = vectors.select(*ids, V.doubles(F.col("v")).alias("v"))
    many = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).alias("_m"))
    left = blocks(rows.join(many, group).withColumn("_a", F.pmod(F.xxhash64("id", "v"), F.col("_m"))), "id", [*group, "_a"])
    left = left.join(counts, group, "left").withColumn("_b", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    met = left.withColumn("_salt", F.pmod("_a", F.lit(SALTS)).cast("int")).join(right, [*group, "_b", "_salt"], "left").select(*ids, "_id", "t", "_t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, own, flat, t, there in pdf.itertuples(index=False, name=None):
                if t is None or not len(t):
                    out = pd.DataFrame({"id": own, "best": None, "similarity": 0.0})
                else:
                    s = np.round(V.unit_rows(np.asarray(flat).reshape(len(own), -1)) @ V.unit_rows(np.asarray(there).reshape(len(t), -1)).T, 12)
                    at = s.argmax(axis=1)
                    out = pd.DataFrame({"id": own, "best": [t[i] for i in at], "similarity": s[np.arange(len(own)), at]})
                for c, k in zip(group, key, strict=True):
                    out[c] = k
                yield out[[*ids, "best", "similarity"]].astype({"best": object})

    best = met.mapInPandas(run, f"{schema}, best {kind}, similarity double")
    # the largest similarity, then the smallest target
    worst = best.groupBy(*ids).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "best")).alias("m"))
    return worst.select(*ids, F.col("m.best").alias("best"), (-F.col("m.s")).alias("similarity"))


def known_so_far(assigned: DataFrame, group: list[str], page: str, order: list[str]) -> DataFrame:
    """group, page, cluster: every cluster that a page or one before it has seen, for each page. Pages and clusters meet by group, then the range."""
    first = assigned.groupBy(*group, "cluster").agg(F.min(page).alias("_first"))
    pages = assigned.select(*group, page).distinct()
    return pages.join(first, group).where(F.col("_first") <= F.col(page)).select(*group, page, "cluster")


def named(characters: DataFrame, names: DataFrame, bound: int = 100_000) -> DataFrame:
    """characters(character_id, ...) with the name given for an id, null if none; the last of repeated names by text. Names are broadcast while they are few."""
    one = names.groupBy("character_id").agg(F.max("name").alias("name"))
    one = F.broadcast(one) if one.limit(bound + 1).count() <= bound else one
    return characters.drop("name").join(one, "character_id", "left")
