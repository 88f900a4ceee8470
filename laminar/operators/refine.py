"""Refinement of clusters by a pairwise verdict: split at the weakest link, merge at the strongest.

The searches over pairs never make a row for a pair of members: they are gathered in blocks, blocks meet, and a meeting gives the extreme pair of each
pair of clusters in it, if the gate lets it pass. Verdicts are asked only for gated extremes. What depends on order, the ids of new clusters and the greedy merges, runs over cluster pairs, not over members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions import vectors as V

#: A key's vectors are dealt to a block for each BLOCK of them, up to SPREAD blocks, so that copies grow as the input does; more only where blocks would be larger than BLOCK_BYTES, which bounds a task.
BLOCK, SPREAD, BLOCK_BYTES = 512, 12, 32 << 20
#: Vectors of either side in one matrix product, and pairs of clusters whose best so far a meeting remembers.
TILE, KNOWN = 1_024, 1 << 20
SPLIT_MAX, MERGE_MIN = 0.6, 0.5


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, cluster, pos, v) -> by, at: array of (cluster, pos), flat: their vectors one after the other."""
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", "pos", "v"))).alias("_all"))
    return held.select(*by, F.transform("_all", lambda x: x["cluster"]).alias("of"), F.transform("_all", lambda x: x["pos"]).alias("pos"), F.flatten(F.transform("_all", lambda x: x["v"])).alias("flat"))


def _meetings(rows: DataFrame, keys: list[str], weakest: bool, gate: float | None) -> DataFrame:
    """rows(keys, cluster, pos, v) -> keys, a, b, sim, i, j, maybe several rows for a pair of clusters.

    Rows are dealt to blocks by hash; each two blocks of a key have a key of their own, at which both arrive one after the other, so that no comic and no cluster is one task's work.
    """
    rows = rows.dropna(subset=keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), (F.sum(F.size("v").cast("bigint")) * 8).alias("_bytes"))
    counts = counts.select(*keys, F.greatest(F.least(F.ceil(F.col("_rows") / F.lit(BLOCK)), F.lit(SPREAD).cast("bigint")), F.ceil(F.col("_bytes") / F.lit(BLOCK_BYTES))).alias("_n"))
    # keys of more than one block are few: at most one for each BLOCK rows or BLOCK_BYTES
    dealt = rows.join(F.broadcast(counts.where("_n > 1")), keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("bigint")))
    blocks = _packed(dealt.withColumn("_b", F.pmod(F.xxhash64("cluster", "pos"), F.col("_n"))), [*keys, "_n", "_b"])
    each = blocks.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    each = each.select(*keys, F.least("_b", "_c").alias("_lo"), F.greatest("_b", "_c").alias("_hi"), "_b", "of", "pos", "flat")
    met = each.repartition(*keys, "_lo", "_hi").sortWithinPartitions(*keys, "_lo", "_hi", "_b")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    cluster = rows.schema["cluster"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, first = None, None
        for pdf in batches:
            for *key, lo, hi, at, of, pos, flat in pdf.itertuples(index=False, name=None):
                block = _block(np.asarray(of), np.asarray(pos), np.asarray(flat))
                if at < hi:
                    whose, first = (key, lo, hi), block
                elif lo == hi or whose == (key, lo, hi):  # else the other block holds no rows
                    for out in _extremes(block if lo == hi else first, block, weakest, gate):
                        for n, (c, k) in enumerate(zip(keys, key, strict=True)):
                            out.insert(n, c, k)
                        yield out

    return met.mapInPandas(run, f"{kinds}, a {cluster}, b {cluster}, sim double, i bigint, j bigint")


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _block(of: np.ndarray, pos: np.ndarray, flat: np.ndarray) -> Block:
    """Clusters, positions and unit vectors of a block, in order of both; vectors that are no numbers are in no pair."""
    units = V.unit_rows(flat.reshape(len(of), -1))
    known = np.isfinite(units).all(axis=1)
    return (of, pos, units) if known.all() else (of[known], pos[known], units[known])


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _extremes(left: Block, right: Block, weakest: bool, gate: float | None) -> Iterator[pd.DataFrame]:
    """Two blocks, or one with itself -> frames of a, b, sim, i, j: of each pair of clusters (weakest: of each cluster), extreme pairs that pass the gate, the first extreme of all among them.

    One product a tile. A tile's pairs are looked at only where the best of two clusters in it is no worse than what the gate and the tiles before left. Similarities count as equal where they agree in 12 decimals.
    """
    (lo, lp, lv), (ro, rp, rv) = left, right
    sign = -1.0 if weakest else 1.0
    floor = -np.inf if gate is None else sign * gate
    lc, rc = np.unique(lo), np.unique(ro)
    best = np.full((len(lc), len(rc)), floor) if len(lc) * len(rc) <= KNOWN else None
    for x in range(0, len(lo), TILE):
        xs = slice(x, x + TILE)
        a, p, lines = lo[xs], lp[xs], lv[xs] * sign
        down = _runs(a)
        for y in range(x if left is right else 0, len(ro), TILE):
            ys = slice(y, y + TILE)
            b, q = ro[ys], rp[ys]
            s = lines @ rv[ys].T
            if weakest and left is right and p[-1] >= q[0]:
                s[p[:, None] == q[None, :]] = -np.inf
            across = _runs(b)
            ends = np.r_[down, len(a)]
            most = np.stack([s[m:n].max(axis=0) for m, n in zip(ends, ends[1:], strict=False)]) if len(down) <= 32 else np.maximum.reduceat(s, down, axis=0)
            most = np.round(np.maximum.reduceat(most, across, axis=1), 12)
            place = np.ix_(np.searchsorted(lc, a[down]), np.searchsorted(rc, b[across]))
            wanted = np.isfinite(most) & (most >= (floor if best is None else best[place]))
            wanted &= (a[down][:, None] == b[across][None, :]) if weakest else (a[down][:, None] != b[across][None, :])
            if not wanted.any():
                continue
            if best is not None:
                best[place] = np.where(wanted, most, best[place])
            at, to = (_few if wanted.sum() <= 64 else _many)(s, np.where(wanted, most, np.inf), down, across)
            i, j, sim = p[at], q[to], np.round(s[at, to], 12) * sign
            a_, b_ = a[at], b[to]
            swap = (a_ > b_) | ((a_ == b_) & (i > j))
            out = pd.DataFrame({"a": np.where(swap, b_, a_), "b": np.where(swap, a_, b_), "sim": sim, "i": np.where(swap, j, i), "j": np.where(swap, i, j)})
            # a pair of clusters can be met from both sides
            yield out.sort_values(["a", "b", "sim", "i", "j"], ascending=[True, True, weakest, True, True]).drop_duplicates(["a", "b"])


def _few(s: np.ndarray, most: np.ndarray, down: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of s that hold the extremes asked for: of each two runs the first by row and the first by column, so the first pair from either side."""
    at, to = [], []
    rows, columns = np.r_[down, len(s)], np.r_[across, s.shape[1]]
    for m, n in zip(*np.nonzero(np.isfinite(most)), strict=True):
        hit = np.round(s[rows[m] : rows[m + 1], columns[n] : columns[n + 1]], 12) == most[m, n]
        y, x = hit.any(axis=1).argmax(), hit.any(axis=0).argmax()
        at += [rows[m] + y, rows[m] + hit[:, x].argmax()]
        to += [columns[n] + hit[y].argmax(), columns[n] + x]
    return np.array(at), np.array(to)


def _many(s: np.ndarray, most: np.ndarray, down: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many runs at once: all rows and columns that hold them."""
    spread = np.repeat(np.repeat(most, np.diff(np.r_[down, len(s)]), axis=0), np.diff(np.r_[across, s.shape[1]]), axis=1)
    return np.nonzero(np.round(s, 12) == spread)


def _members(members: DataFrame) -> DataFrame:
    return members.select("comic", "cluster", "pos", V.doubles(F.col("v")).alias("v"))


def weakest_pairs(members: DataFrame, at_most: float | None = None) -> DataFrame:
    """comic, cluster, sim, i, j: the least similar pair of members, the first of equals; no row for clusters of one, nor where that pair is more similar than `at_most`."""
    rows = _members(members).withColumn("_own", F.col("cluster"))
    best = _meetings(rows, ["comic", "_own"], True, at_most).groupBy("comic", F.col("a").alias("cluster")).agg(F.min(F.struct("sim", "i", "j")).alias("m"))
    return best.select("comic", "cluster", "m.sim", "m.i", "m.j")


def strongest_pairs(members: DataFrame, at_least: float | None = None) -> DataFrame:
    """comic, a, b (a < b), sim, i, j: the most similar pair of members of two clusters, the first of equals; no row where it is less similar than `at_least`."""
    best = _meetings(_members(members), ["comic"], False, at_least).groupBy("comic", "a", "b").agg(F.min(F.struct((-F.col("sim")).alias("s"), "i", "j")).alias("m"))
    return best.select("comic", "a", "b", (-F.col("m.s")).alias("sim"), "m.i", "m.j")


Verdict = Callable[[DataFrame], DataFrame]


def _asked(pairs: DataFrame, members: DataFrame, a: str, b: str, verdict: Verdict) -> DataFrame:
    """pairs with crop_a, crop_b and same, from the pluggable verdict (a DataFrame transform that adds `same`)."""
    crops = members.select("comic", "cluster", "pos", "crop")
    left = crops.select("comic", F.col("cluster").alias(a), F.col("pos").alias("i"), F.col("crop").alias("crop_a"))
    right = crops.select("comic", F.col("cluster").alias(b), F.col("pos").alias("j"), F.col("crop").alias("crop_b"))
    joined = pairs.join(left, ["comic", a, "i"]).join(right, ["comic", b, "j"])
    return verdict(joined)


def _greedy(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Checks in order of (a, b); a pair judged the same locks both, so that a cluster takes part in one merge at most."""
    locked, out = set(), []
    for r in pdf.sort_values(["a", "b"]).itertuples(index=False):
        if r.a in locked or r.b in locked:
            continue
        out.append((key[0], r.a, r.b, r.sim, bool(r.same)))
        if r.same:
            locked |= {r.a, r.b}
    return pd.DataFrame(out, columns=["comic", "a", "b", "sim", "same"])


def refine(members: DataFrame, verdict: Verdict, split_max: float = SPLIT_MAX, merge_min: float = MERGE_MIN) -> tuple[DataFrame, DataFrame]:
    """members(comic, cluster, pos, v, crop) -> (members after one pass, log).

    Clusters are numbered from 0; a split's second part gets the next number after the largest (so numbers never collide, even after earlier merges).
    Members of a merged cluster follow those of the one that takes them. log: comic, seq, type, cluster, other, sim, same, size_a, size_b.
    """
    members = members.select("comic", "cluster", F.col("pos").cast("bigint").alias("pos"), V.doubles(F.col("v")).alias("v"), "crop")
    weak = weakest_pairs(members, split_max).withColumnsRenamed({"cluster": "a"}).withColumn("b", F.col("a"))
    checks = _asked(weak, members, "a", "b", verdict).persist()
    top = members.groupBy("comic").agg(F.max("cluster").alias("top"))
    nth = F.row_number().over(Window.partitionBy("comic").orderBy("a"))
    splits = checks.where(~F.col("same")).join(top, "comic").select("comic", F.col("a").alias("cluster"), "i", "j", (F.col("top") + nth).cast("int").alias("to"))
    seed = members.select("comic", "cluster", F.col("pos"), "v")
    seeds = splits.join(seed.withColumnsRenamed({"pos": "i", "v": "va"}), ["comic", "cluster", "i"]).join(seed.withColumnsRenamed({"pos": "j", "v": "vb"}), ["comic", "cluster", "j"]).select("comic", "cluster", "to", "va", "vb")
    parted = members.join(seeds, ["comic", "cluster"], "left")
    second = F.col("to").isNotNull() & (V.cosine(F.col("v"), F.col("va")) < V.cosine(F.col("v"), F.col("vb")))
    after = parted.select("comic", F.when(second, F.col("to")).otherwise(F.col("cluster")).alias("cluster"), "pos", "v", "crop", F.when(F.col("to").isNotNull(), F.col("cluster")).alias("_from"))
    renumber = F.row_number().over(Window.partitionBy("comic", "cluster").orderBy("pos")) - 1
    after = after.withColumn("pos", renumber.cast("bigint")).persist()
    sizes = after.where("_from is not null").groupBy("comic", F.col("_from").alias("cluster")).agg(
        F.count_if(F.col("cluster") == F.col("_from")).alias("size_a"), F.count_if(F.col("cluster") != F.col("_from")).alias("size_b"))
    strong = strongest_pairs(after, merge_min)
    judged = _asked(strong, after, "a", "b", verdict).select("comic", "a", "b", "sim", "same")
    kind = members.schema["comic"].dataType.simpleString()
    merges = judged.groupBy("comic").applyInPandas(_greedy, f"comic {kind}, a int, b int, sim double, same boolean").persist()
    taken = merges.where("same").select("comic", F.col("b").alias("cluster"), F.col("a").alias("into"))
    final = after.drop("_from").join(taken, ["comic", "cluster"], "left").withColumn("_second", F.col("into").isNotNull())
    final = final.withColumn("cluster", F.coalesce("into", "cluster"))
    place = F.row_number().over(Window.partitionBy("comic", "cluster").orderBy("_second", "pos")) - 1
    final = final.select("comic", "cluster", place.cast("bigint").alias("pos"), "v", "crop")
    none = lambda t: F.lit(None).cast(t)
    log = checks.select("comic", F.lit(0).alias("phase"), F.lit("split_check").alias("type"), F.col("a").alias("cluster"), none("int").alias("other"), "sim", "same", none("bigint").alias("size_a"), none("bigint").alias("size_b"))
    log = log.unionByName(splits.join(sizes, ["comic", "cluster"]).select("comic", F.lit(1).alias("phase"), F.lit("split_applied").alias("type"), "cluster", F.col("to").alias("other"), none("double").alias("sim"), none("boolean").alias("same"), "size_a", "size_b"))
    for kind_, rows in (("merge_check", merges), ("merge_applied", merges.where("same"))):
        own = [F.col("sim"), F.col("same")] if kind_ == "merge_check" else [none("double").alias("sim"), none("boolean").alias("same")]
        log = log.unionByName(rows.select("comic", F.lit(2).alias("phase"), F.lit(kind_).alias("type"), F.col("a").alias("cluster"), F.col("b").alias("other"), *own, none("bigint").alias("size_a"), none("bigint").alias("size_b")))
    seq = F.row_number().over(Window.partitionBy("comic").orderBy("phase", "cluster", "other", F.col("type").desc())) - 1
    return final, log.withColumn("seq", seq).drop("phase")


def cluster_summary(members: DataFrame) -> DataFrame:
    """comic, clusters, sizes (descending)."""
    per = members.groupBy("comic", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("comic").agg(F.count("*").alias("clusters"), F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))


def log_summary(log: DataFrame) -> DataFrame:
    """comic, checks, splits, merges."""
    t = F.col("type")
    return log.groupBy("comic").agg(F.count_if(t.isin("split_check", "merge_check")).alias("checks"), F.count_if(t == "split_applied").alias("splits"), F.count_if(t == "merge_applied").alias("merges"))
