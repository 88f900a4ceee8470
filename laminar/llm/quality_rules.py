"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus. Built-in functions only.

Word unigrams and bigrams are hashed into BUCKETS buckets. Two multinomials over the buckets are counted: the target's over trusted documents
(labelled good; at most TRUSTED of them, those with the smallest hash of doc_id), and the raw corpus's over all documents. The target's is smoothed towards
the raw corpus's, by PRIOR expected counts a bucket, so that rare n-grams of documents nobody has labelled don't count against them. A document's verdict is
the mean of log(target / raw) over its n-grams, plus SLACK over the root of their number, compared with THRESHOLD, the same at every size; no randomness.

Counting is one pass whose rows are combined map-side (the shuffle carries at most BUCKETS rows a task); scoring is a narrow pass
with the ratios, a written table of one row of BUCKETS numbers, as a scalar subquery. No document leaves its row, and no count becomes a row or a literal on the driver.

Base rules, whatever the ratio: under 20 words, or over 30 % of the words in repeated windows of 8 words, fail.

Defined results: null text has no words and fails; ties of the smallest hash fall to the smaller doc_id; without trusted
documents, the ratio is 0 everywhere, so the base rules alone decide; an empty table gives no rows; repeated rows are counted and judged each;
very long texts are read whole, their arrays of hashes take 8 bytes a word; columns other than doc_id and text are ignored or, by kept_rows(), handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

BUCKETS = 262_144
#: Bound of the trusted sample, in documents: their ids, 8 bytes each, are broadcast.
TRUSTED = 50_000
PRIOR = 10
THRESHOLD, SLACK = -0.1, 0.3
WINDOW = 8
MIN_WORDS = 20


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: `ratios`, log(target / raw) of each bucket from counts over all documents, as one array. Written, so that a scalar subquery reads it."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("target", F.lit(1))), "doc_id", "left")
    words = marked.select(common.split_words(F.col("text")).alias("words"), "target")
    hashed = words.select(arrays.hashes(F.col("words")).alias("h1"), "target")
    # explode() of the expression, not of a column: for a column, Catalyst adds a filter on its size, which would compute the words twice
    grams = F.explode(F.concat("h1", arrays.doubled(F.col("h1"), 1)))
    counts = hashed.select(grams.alias("h"), "target").groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.count("target").alias("target"))
    counts = common.written(counts, "quality-counts")
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = (sums["target"] or 0) / max(1, sums["raw"] or 0)
    every = counts.unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target")))
    each = every.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    ratio = F.log((F.col("target") + PRIOR) / (F.col("raw") * share + PRIOR)) if share else F.lit(0.0)
    # one row of BUCKETS numbers, whatever the data
    packed = each.select("b", F.round(ratio, 5).alias("x")).agg(F.array_sort(F.collect_list(F.struct("b", "x"))).alias("all"))
    table = common.written(packed.select(F.transform("all", lambda e: e["x"]).alias("ratios")), "quality-ratios")
    common.dropped(counts)
    return table


def rules(docs: DataFrame, weights: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr (and `extra` columns)."""
    extra = extra or []
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", *extra, text.alias("_t"), lines.alias("_lines"))
    df = df.select(
        "doc_id", *extra, common.split_words(F.col("_t")).alias("_words"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = df.select("*", arrays.hashes(F.col("_words")).alias("_h1"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"))
    df = df.select("*", arrays.doubled(F.col("_h1"), 1).alias("_h2")).drop("_words")
    df = df.select("*", arrays.doubled(F.col("_h2"), 2).alias("_h4"))
    df = df.select("*", arrays.doubled(F.col("_h4"), 4).alias("_h8")).drop("_h4")
    # a scalar subquery, read once; it is used once, so Catalyst puts it where it is used and it never is a column of rows
    df = df.select("*", weights.scalar().alias("_table"))
    total = F.aggregate(F.concat("_h1", "_h2"), F.lit(0.0), lambda acc, x: acc + F.get("_table", bucket(x).cast("int")))
    df = df.select(*[c for c in df.columns if c not in ("_table", "_h1", "_h2")], total.alias("_sum"), (F.size("_h1") + F.size("_h2")).alias("_n"), F.size("_h1").cast("long").alias("n_words"))
    df = arrays.with_repeated(df, "_h8", "_starts").drop("_h8")
    repeats = F.coalesce(arrays.covered(F.col("_starts"), WINDOW), F.lit(0)).cast("long")
    df = df.select(
        "doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        (F.col("_sum") / F.greatest("_n", F.lit(1))).alias("llr"), F.greatest("_n", F.lit(1)).alias("_n"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") + F.lit(SLACK) / F.sqrt("_n") >= THRESHOLD)).drop("_n")


def judge(docs: DataFrame, labels: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return rules(docs, ratios(docs, trusted_ids(labels)), extra=extra)


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, whatever their columns, that are kept."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    out = judge(packed, labels, extra=["_row"])
    # the id stops Catalyst from moving the filter below the projections, where it would repeat their work many times over
    out = out.withColumn("_at", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
