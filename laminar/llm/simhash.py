"""SimHash near-duplicates by meeting in the middle: every fingerprint emits its whole ball of half the radius.

Two fingerprints within distance 2 r' share a variant within r' of both, so grouping the variants finds every pair and nothing has
to be guessed or tuned. Equal fingerprints are made one first. A variant's group has at most one ball's worth of members (65 for radius 2),
whatever the data; sorted, each member is tied to the one before, which keeps all reachability with one edge a member instead of one per pair, and
each tie is verified by its differing bits.

Defined results: null text and text without words have fingerprint 0, linked like any other; null doc_ids get the component
of their fingerprint and are never its smallest, which is null only if no row has an id; repeated rows are kept; very long texts are read whole,
8 bytes a shingle in the task that holds them; an empty table gives no rows; columns other than doc_id and text are ignored or, by keep_one(), handed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, components

SEED = 42
RADIUS = 2


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the word shingles. bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces only."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else (b" ".join(w),)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16_384):
        ones += np.unpackbits(h[i : i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _prints(size: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), size) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(fp)], [*(c for c in b.schema.names if c != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """`keys` and fp (long: the bits of the fingerprint). A narrow map."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(common.lean(_prints(size)), f"{schema}, fp bigint")


def ball(fp: Column, radius: int) -> Column:
    """All values within `radius` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), distinct -> edges a < b, verified, that connect whatever is linked within `radius` bits."""
    variants = fps.select("fp", F.explode(ball(F.col("fp"), -(-radius // 2))).alias("variant"))
    if radius % 2:
        # the ball of an odd radius is rounded up, so its members may be too far apart: all pairs of a group are tried
        met = variants.groupBy("variant").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        pairs = met.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    else:
        before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
        pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows(doc_id, fp, ...) -> the rows with label (of the component) and component_id (its smallest doc_id). Written tables cut the lineage after fingerprints and links."""
    distinct = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components.components(links(distinct.select("fp"), radius))
    named = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    before, named = distinct, common.written(named, "simhash-labels")
    common.dropped(before, labels)
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    per_fp = named.join(smallest, "label").select("fp", "label", "component_id")
    return fps.join(per_fp, "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    fps = common.written(fingerprints(docs, ["doc_id"], size), "simhash-prints")
    return linked(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each component: the smallest (doc_id, text hash).

    Rows are known by hashes of the text and of (doc_id, length) while fingerprints are linked; of rows that agree in both, the one with the smallest hash of the whole row stays.
    """
    text = F.col("text")
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.octet_length(text))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64(text).alias("_h"), row.alias("_g"))
    fps = common.written(fingerprints(keyed, ["doc_id", "_h", "_g"], size), "simhash-prints").distinct()
    best = linked(fps, radius).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h", "_g")).alias("m"))
    kept = keyed.select("_row", "_h", "_g").join(best.select("m._h", "m._g"), ["_h", "_g"], "left_semi")
    # equal in doc_id and text: dealt like the join before, so nothing moves again
    return kept.groupBy("_h", "_g").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
