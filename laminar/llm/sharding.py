"""Sharding by a k-d tree: split every node at the weighted median of its widest metadata dimension until leaves are small.

Dimensions are the metadata columns (text columns by the order of their first six bytes) and the size. Equal texts are one group and have
one place in the tree: the least metadata among the group's rows. A row's key in a node is (value on the node's widest dimension, crc32 of the text), and the node is
cut where half of its bytes lie below. If the group at that place is heavier than TOLERANCE of the node, it is set aside for the side where most of it lies and the
rest of the node is cut so that the sides balance; this goes on while the group met is lighter than the last. Hence a group stays whole unless it is larger than half of
a node (more than a shard): then it alone is cut inside, by doc_id and at last by row.

All work is DataFrame operations over a table of a few numbers a row, written anew for every level. A median is a radix search: histograms of BINS bins a node,
combined map-side, of which one bin a node reaches the driver; cuts go back as array literals indexed by node. Nothing is joined or broadcast while the tree grows, and
what reaches the driver is bounded by the number of leaves, total bytes / target bytes.

Defined results: null text weighs 1 byte and has crc32 0; null or missing metadata come first; repeated rows each get a slot (rows that agree in doc_id and text are interchangeable,
and are cut by row); ties of a key are one place and never cut, but for the groups named above; very long texts are one row of their size and may make a shard larger than the others; an empty table gives no
rows; columns other than doc_id, text and the dimensions are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BINS = 2048
#: Share of a node by which its sides may miss the half before a group is set aside.
TOLERANCE = 0.002
#: Rows in a numbering bucket, about.
SLOT_ROWS = 20_000
END = 2**62


def _at(values: list, kind: str = "bigint") -> Column:
    """The value of the row's node, from a literal array."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("node"))


def _search(rows: DataFrame, key: str, targets: dict[int, int], ranges: dict[int, tuple[int, int]], size: int) -> dict[int, tuple[int, int, int]]:
    """For every node of `targets`: the key at which the running weight reaches the target, the weight below that key, and its own; no entry if the node weighs less.

    rows: node, w and the key, within the node's range. Each pass splits the range that holds the place into BINS bins; the least and greatest key that the bin really has are the next range.
    """
    open_, done = {n: (*ranges[n], 0) for n in targets}, {}
    while open_:
        low, high, step, need, under = ([0] * size for _ in range(5))
        for n in range(size):
            low[n], high[n], under[n] = open_.get(n, (1, 0, 0))
            step[n], need[n] = max(1, -(-(high[n] - low[n] + 1) // BINS)), targets.get(n, 0)
        ranged = rows.select("node", key, "w", _at(low).alias("_lo"), _at(step).alias("_step")).where(F.col(key).between(F.col("_lo"), _at(high)))
        bins = ranged.groupBy("node", F.expr(f"({key} - _lo) div _step").alias("bin")).agg(F.sum("w").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + _at(under)
        hit = bins.withColumn("upto", upto).where((F.col("upto") >= _at(need)) & (F.col("upto") - F.col("w") < _at(need)))
        found = {r["node"]: r for r in hit.collect()}
        done |= {n: (r["lo"], r["upto"] - r["w"], r["w"]) for n, r in found.items() if r["lo"] == r["hi"]}
        open_ = {n: (r["lo"], r["hi"], r["upto"] - r["w"]) for n, r in found.items() if n not in done}
    return done


def _aside(groups: dict[int, list[tuple[int, int, int]]], size: int) -> Column:
    """The side (0 left, 1 right) for which the row's group is set aside, or null."""
    if not groups:
        return F.lit(None).cast("int")
    listed = _at([[{"v": v, "c": c, "s": s} for v, c, s in groups.get(n, [])] for n in range(size)], "array<struct<v:bigint,c:bigint,s:int>>")
    return F.get(F.filter(listed, lambda x: (x["v"] == F.col("v")) & (x["c"] == F.col("crc"))), F.lit(0))["s"]


def _cuts(rows: DataFrame, total: dict[int, int], ranges: dict[int, tuple[int, int]], size: int) -> tuple[dict[int, tuple[int, int, int, int]], dict[int, list]]:
    """For every node the cut (v, crc, tie, uid), below which rows go left, and the groups set aside.

    rows: node, v (within the node's range), crc, tie, uid, w.
    """
    word, row = dict.fromkeys(total, (0, 2**32 - 1)), dict.fromkeys(total, (0, END))
    cuts, aside, last = {}, {}, dict.fromkeys(total, END)
    room = {n: [w // 2, w - w // 2] for n, w in total.items()}
    pending = dict.fromkeys(total)
    while pending:
        rest = rows.where(_aside(aside, size).isNull()) if aside else rows
        by_value = _search(rest, "v", {n: max(1, room[n][0]) for n in pending}, ranges, size)
        values = [by_value[n][0] if n in by_value else -1 for n in range(size)]
        at_value = rest.where(F.col("v") == _at(values))
        by_crc = _search(at_value, "crc", {n: max(1, room[n][0] - below) for n, (_, below, _) in by_value.items()}, word, size)
        inside = {}
        for n in list(pending):
            if n not in by_crc:  # what is not aside weighs less than the left side takes
                cuts[n] = (END, 0, 0, 0)
                del pending[n]
                continue
            (v, below, _), (c, more, w) = by_value[n], by_crc[n]
            short = max(0, room[n][0] - below - more)  # of the group's weight, what the left side still takes
            slack = total[n] * TOLERANCE
            if w > total[n] - total[n] // 2 and min(short, w - short) > slack:
                inside[n] = (v, c, short)
            elif min(short, w - short) > slack and w < last[n]:
                side = 0 if (2 * short >= w and w <= room[n][0]) or w > room[n][1] else 1
                aside.setdefault(n, []).append((v, c, side))
                room[n][side] -= w
                last[n] = w
                continue
            else:
                cuts[n] = (v, c, END if 2 * short >= w else -1, 0)
            del pending[n]
        if inside:
            here = at_value.where(F.col("crc") == _at([inside[n][1] if n in inside else -1 for n in range(size)]))
            by_tie = _search(here, "tie", {n: max(1, short) for n, (_, _, short) in inside.items()}, word, size)
            here = here.where(F.col("tie") == _at([by_tie[n][0] if n in by_tie else -1 for n in range(size)]))
            by_row = _search(here, "uid", {n: max(1, inside[n][2] - below) for n, (_, below, _) in by_tie.items()}, row, size)
            for n, (v, c, short) in inside.items():
                uid, below, w = by_row[n]
                cuts[n] = (v, c, by_tie[n][0], uid + (2 * (short - by_tie[n][1] - below) >= w))
    return cuts, aside


def kd_leaves(work: DataFrame, dims: list[str], depth: int) -> DataFrame:
    """`work` with its `node`, 0 .. 2**depth - 1. work: dims (0 .. 2**62), node (0), w (1 or more), crc, tie and uid (0 .. 2**62)."""
    spans: dict[str, int] = {}
    for level in range(depth):
        ask = [F.sum("w").alias("w")] + [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
        nodes = {r["node"]: r for r in work.groupBy("node").agg(*ask).collect()}
        if not nodes:
            break
        size = 2**level
        spans = spans or {d: max(1, nodes[0][f"hi_{d}"] - nodes[0][f"lo_{d}"]) for d in dims}
        widest = {n: max(range(len(dims)), key=lambda i, r=r: ((r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"]) / spans[dims[i]], -i)) for n, r in nodes.items()}
        dim = _at([widest.get(n, 0) for n in range(size)], "int")
        keyed = work.withColumn("v", F.coalesce(*[F.when(dim == i, F.col(d)) for i, d in enumerate(dims)]))
        ranges = {n: (nodes[n][f"lo_{dims[i]}"], nodes[n][f"hi_{dims[i]}"]) for n, i in widest.items()}
        cuts, aside = _cuts(keyed, {n: r["w"] for n, r in nodes.items()}, ranges, size)
        limit = F.struct(*[_at([cuts[n][k] if n in cuts else 0 for n in range(size)]) for k in range(4)])
        right = F.when(F.struct("v", "crc", "tie", "uid") < limit, 0).otherwise(1)
        side = F.coalesce(_aside(aside, size), right) if aside else right
        before, work = work, common.written(keyed.withColumn("node", F.col("node") * 2 + side).drop("v"), f"kd-level-{level}")
        common.dropped(before)
    return work


def numbered(df: DataFrame, shard: str, order: list[str], total: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard, without gathering a shard in one task.

    Equal rows are counted first, by the partition they come from; rows are numbered inside hashed buckets of about SLOT_ROWS rows, and buckets start where the ones before end.
    """
    n = max(1, min(100_000, math.ceil(total / SLOT_ROWS)))
    keys = df.columns
    rows = df.groupBy(*keys, F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_times"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("long"))
    counts = rows.groupBy(shard, "_bucket").agg(F.sum("_times").alias("n"))
    # one row a shard and bucket
    start = F.sum("n").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("n")
    starts = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), start.alias("_start"))
    within = F.sum("_times").over(Window.partitionBy(shard, "_bucket").orderBy(*order, "_part")) - F.col("_times")
    placed = rows.withColumn("_within", within).join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    first = F.col("_start") + F.col("_within")
    return placed.select(*keys, F.explode(F.sequence(first, first + F.col("_times") - 1)).alias("slot"))


def coordinate(c: Column) -> Column:
    """A whole number that orders values of a text column by their first six bytes; null is 0."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(c.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None, metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null).

    shards: a power of two, or target_bytes, from which it follows. metadata: columns of `docs` that are dimensions beside the size; those it lacks are left out.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    metadata = [m for m in metadata if m in docs.columns]
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("w"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("_text"),
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("tie"), *[coordinate(F.col(m)).alias(f"d_{m}") for m in metadata],
    )
    dims = [f"d_{m}" for m in metadata]
    if dims:
        # written first, so that the join has exchanges of its own on both sides, whose large partitions Spark splits
        groups = common.written(rows.groupBy(F.col("w").alias("_w"), F.col("_text").alias("_t")).agg(*[F.min(d).alias(d) for d in dims]), "kd-groups")
        rows = rows.drop(*dims).join(groups, (F.col("w") == F.col("_w")) & (F.col("_text") == F.col("_t"))).drop("_w", "_t")
    work = rows.drop("_text").select("*", F.col("w").alias("d_size"), F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("long").alias("node"))
    work = common.written(work, "kd-rows")
    facts = work.agg(F.sum("w").alias("bytes"), F.count("*").alias("rows")).first()
    if target_bytes:
        shards = 2 ** max(0, math.ceil(math.log2(max(1, (facts["bytes"] or 0) / target_bytes))))
    depth = int(math.log2(shards))
    if 2**depth != shards:
        raise ValueError("the number of shards must be a power of two")
    leaves = kd_leaves(work, [*dims, "d_size"], depth)
    rows = leaves.select("doc_id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.col("node").cast("int").alias("shard"))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], facts["rows"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(common.table(spark, sf_dir, "documents"), 16)
