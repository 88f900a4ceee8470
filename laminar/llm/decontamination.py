"""Benchmark decontamination: the items' normalised word windows are a hash set that every task holds; documents are scanned against it.

Built-in functions only. Window hashes of a document come from three doublings of word hashes (1, 2, 4, 8 words). The set is a hash table in one row of a
written table, an array of slots with (hash, window, its items), which tasks read as a scalar subquery: no document is exploded or shuffled, and a window costs one look at its slot.
A hit is verified by its words, not only its hash, and brings its items with it.

The set is held by every task while the benchmark has at most SET_WINDOWS distinct windows (it is counted; about 150 bytes a window).
Beyond that, document windows are exploded as (row, position, hash) and joined with the windows' hashes by a shuffle, and only hits are compared by words; results are the same.

Items with 1 to 7 words are one window of that length. Defined results: null text has no words; an item without words
has no window; repeated items count by item_id; an empty benchmark hits nothing; an empty table gives no rows; repeated documents get a row each; very long texts are scanned whole, their arrays
of hashes take 8 bytes a word; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

SIZE = 8
#: Complement of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
GAP_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SET_WINDOWS = 100_000


def words(text: Column) -> Column:
    return common.split_words(common.lower_ascii(text), GAP_RE)


def windows_at(w: Column, size: int) -> Column:
    """All windows of `size` words as strings."""
    n = F.size(w) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size, win: every distinct window of every item."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(SIZE))
    wins = F.when(F.size("w") >= SIZE, windows_at(F.col("w"), SIZE)).otherwise(F.array(F.array_join("w", " ")))
    return w.select("item_id", size.alias("size"), F.explode(wins).alias("win")).distinct()


HIT = "array<struct<pos:int,size:int,win:string,items:array<string>>>"


def ladder(w: Column) -> Column:
    """The hash of a window of 8 words as documents are hashed, from its words."""
    h = [F.xxhash64(F.get(w, F.lit(i))) for i in range(SIZE)]
    for _ in range(3):
        h = [F.xxhash64(a, b) for a, b in zip(h[::2], h[1::2], strict=True)]
    return h[0]


def hashed_windows(items: DataFrame) -> DataFrame:
    """size, win, h, items: every distinct window, its hash and the ids of its items as text."""
    known = items.groupBy("size", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return known.withColumn("h", F.when(F.col("size") == SIZE, ladder(F.split("win", " "))).otherwise(F.xxhash64("size", "win")))


def window_hashes(df: DataFrame, sizes: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """df(_w) with a column of the hashes of its windows for each size, in order, and the columns' names."""
    names = {}
    if SIZE in sizes:
        df = df.select("*", arrays.hashes(F.col("_w")).alias("_h1"))
        df = df.select("*", arrays.doubled(F.col("_h1"), 1).alias("_h2")).drop("_h1")
        df = df.select("*", arrays.doubled(F.col("_h2"), 2).alias("_h4")).drop("_h2")
        df = df.select("*", arrays.doubled(F.col("_h4"), 4).alias("_h8")).drop("_h4")
        names[SIZE] = "_h8"
    for n in (s for s in sizes if s < SIZE):
        names[n] = f"_short{n}"
        df = df.withColumn(names[n], F.transform(windows_at(F.col("_w"), n), lambda x: F.xxhash64(F.lit(n), x)))  # noqa: B023
    return df, names


def hash_set(windows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row: `slots`, an array in which the entries of hash h are at h modulo the array's length, null where there are none; and that length."""
    slots = 1 << max(4, (4 * n - 1).bit_length())
    entries = windows.select(slot(F.col("h"), slots).alias("slot"), F.struct("h", "win", "items").alias("e"))
    every = entries.unionByName(windows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast(entries.schema["e"].dataType).alias("e")))
    filled = every.groupBy("slot").agg(F.collect_list("e").alias("all")).select("slot", F.when(F.size("all") > 0, F.col("all")).alias("all"))
    # one row, of at most SET_WINDOWS entries
    packed = filled.agg(F.array_sort(F.collect_list(F.struct("slot", "all"))).alias("x")).select(F.transform("x", lambda x: x["all"]).alias("slots"))
    return common.written(packed, "decontamination-set"), slots


def slot(h: Column, slots: int) -> Column:
    return h.bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")


def hit_windows(docs: DataFrame, windows: DataFrame, sizes: list[int], n: int, extra: list[str]) -> DataFrame:
    """docs + n_words, hits: array<struct<pos, size, win, items>> of the verified windows, by position."""
    df = docs.select("doc_id", *extra, words(F.col("text")).alias("_w"))
    found = [F.array().cast(HIT)]
    table, slots = hash_set(windows, n)
    df, names = window_hashes(df, sizes)
    for size, h in names.items():
        # the subquery is used once in each projection, so Catalyst puts it there and it never is a column of rows
        df = df.withColumn("_set", table.scalar())
        among = lambda x: F.exists(F.get("_set", slot(x, slots)), lambda e: e["h"] == x)
        df = df.select(*[c for c in df.columns if c != "_set"], F.filter(F.transform(h, lambda x, i: F.when(among(x), F.struct(i.alias("i"), x.alias("h")))), lambda x: x.isNotNull()).alias("_at")).drop(h)  # noqa: B023
        at = F.transform("_at", lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.array_join(F.slice("_w", x["i"] + 1, size), " ").alias("win")))  # noqa: B023
        df = df.select(*[c for c in df.columns if c != "_at"], F.when(F.size("_at") > 0, at).alias("_met")).withColumn("_set", table.scalar())
        entry = lambda x: F.get(F.filter(F.get("_set", slot(x["h"], slots)), lambda e: (e["h"] == x["h"]) & (e["win"] == x["win"])), F.lit(0))
        hit = F.transform("_met", lambda x: F.struct(x["i"].alias("pos"), F.lit(size).alias("size"), x["win"].alias("win"), entry(x)["items"].alias("items")))  # noqa: B023
        df = df.select(*[c for c in df.columns if c not in ("_set", "_met")], F.coalesce(F.filter(hit, lambda x: x["items"].isNotNull()), F.array().cast(HIT)).alias(f"_hits{size}"))
        found.append(F.col(f"_hits{size}"))
    hits = F.array_sort(F.concat(*found)) if len(found) > 2 else found[-1]
    return df.select("doc_id", *extra, F.size("_w").cast("long").alias("n_words"), hits.cast(HIT).alias("hits"))


def covered(hits: Column) -> Column:
    """Words inside any hit window; hits are ordered by position."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], (x["pos"] + x["size"]).cast("long")).alias("end"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), (x["pos"] + x["size"]).cast("long") - F.greatest(acc["end"], x["pos"].cast("long")))).alias("n"),
    )
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def joined_windows(docs: DataFrame, windows: DataFrame, sizes: list[int], extra: list[str]) -> DataFrame:
    """hit_windows() for a benchmark of any size: hashes are exploded and joined by a shuffle, and the documents with such windows are compared by words."""
    df = docs.select("doc_id", *extra, words(F.col("text")).alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    df = common.written(df, "decontamination-words")
    out = df.select("_row", "doc_id", *extra, F.size("_w").cast("long").alias("n_words"))
    if not sizes:
        return out.select("doc_id", *extra, "n_words", F.array().cast(HIT).alias("hits"))
    windows = common.written(windows, "decontamination-windows")
    wide, names = window_hashes(df.select("_row", "_w"), sizes)
    seen = None
    for n, h in names.items():
        part = wide.select("_row", F.posexplode(h).alias("pos", "h")).withColumn("size", F.lit(n))
        seen = part if seen is None else seen.unionByName(part)
    met = seen.join(windows.select("size", "h").distinct(), ["size", "h"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("pos", "size")).alias("at"))
    at = df.select("_row", "_w").join(met, "_row").select("_row", F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["size"].alias("size"), F.array_join(F.slice(F.col("_w"), x["pos"] + 1, x["size"]), " ").alias("win"))).alias("at"))
    at = at.select("_row", F.explode("at").alias("x")).select("_row", "x.*")
    hits = at.join(windows.select("size", "win", "items"), ["size", "win"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "win", "items"))).cast(HIT).alias("hits"))
    return out.join(hits, "_row", "left").select("doc_id", *extra, "n_words", F.coalesce("hits", F.array().cast(HIT)).alias("hits"))


def scan(docs: DataFrame, benchmark: DataFrame, bound: int = SET_WINDOWS, extra: list[str] | None = None, with_hits: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, `extra`, and, asked for, hits."""
    extra = extra or []
    items = common.written(item_windows(benchmark), "decontamination-items")
    windows = hashed_windows(items)
    facts = windows.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    n, sizes = facts["n"], facts["sizes"]
    found = hit_windows(docs, windows, sizes, n, extra) if n <= bound else joined_windows(docs, windows, sizes, extra)
    found = found.withColumn("n_hit", F.when(F.size("hits") > 0, covered(F.col("hits"))).otherwise(F.lit(0)).cast("long"))
    met = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    rows = found.withColumn("items", F.when(F.size("hits") > 0, met).otherwise(F.array().cast("array<string>")))
    keep = ["doc_id", *extra, "n_words", "n_hit", *(["hits"] if with_hits else [])]
    return rows.select(
        *keep, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"), "items",
    )


#: A word with the gap before it, in the text as it is.
PIECE_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def without(text: Column, hits: Column) -> Column:
    """The text without the words of the hits and the gaps before them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE_RE), F.lit(0))
    rest = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    left = F.filter(pieces, lambda p, i: ~F.exists(hits, lambda x: (i >= x["pos"]) & (i < x["pos"] + x["size"])))
    return F.concat(F.array_join(left, ""), rest)


def merged(hits: Column) -> Column:
    """Hits, ordered by position, as disjoint spans."""
    none = F.array().cast("array<struct<pos:int,size:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        end = F.greatest(last["pos"] + last["size"], x["pos"] + x["size"])
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["pos"].alias("pos"), (end - last["pos"]).alias("size"))))
        return F.when((F.size(acc) > 0) & (x["pos"] <= last["pos"] + last["size"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["pos"].alias("pos"), x["size"].alias("size")))))

    return F.aggregate(hits, none, step)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, whatever their columns, that are not contaminated; the words of a single item that a text holds are cut out."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))
    out = scan(packed, benchmark, extra=["_doc"], with_hits=True)
    # the id stops Catalyst from moving the filter below the projections, where it would repeat their work
    out = out.withColumn("_at", F.monotonically_increasing_id()).where(~F.col("contaminated") & (F.col("_at") >= 0))
    # spans as a column of its own, used twice, else Catalyst moves it into the lambda of without(), to be merged again for every word
    out = out.select("_doc", F.when(F.size("hits") > 0, merged(F.col("hits"))).alias("_spans"))
    clean = F.when(F.size("_spans") > 0, without(F.col("_doc.text"), F.col("_spans"))).otherwise(F.col("_doc.text"))
    return out.select(*[clean.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
seen AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, p, k, item_id FROM seen JOIN win USING (k, win)),
word AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
item AS (SELECT r, count(DISTINCT item_id) AS n_items, list_aggregate(list_sort(list(DISTINCT item_id::VARCHAR)), 'string_agg', ',') AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""
