"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, partitioned tables.

    p(w | u) = d(c(uw)) c(uw) / c(u)   if c(uw) > 0,   else   alpha(u) p(w)
    p(w)     = d(c(w)) c(w) / N        if c(w) > 0,    else   what the discounts leave, for the one unknown word

A context is the word before, or the start of the text. alpha(u) is what u's discounts leave, divided by 1 - the sum of p(w) over
words seen after u, so that every context's probabilities sum to one.

A token is not a row: texts are cut into blocks of about BLOCK_TOKENS tokens, and a block exchanges with the count tables its distinct keys,
sorted and packed (5 to 6 bytes a key), so that words that fill a third of a corpus cost one key a block. Steps:

1. blocks: every text becomes token numbers and each block's distinct words (64-bit hashes) and counts; a table bucketed by block.
2. unigrams: blocks' words meet in hash ranges, are summed, and each block gets the counts of its words back.
3. bigrams: blocks' distinct pairs, with the counts of their second words, meet in ranges of the first word's hash; frequent first words are
   dealt to several ranges by their second words. They are summed and each block gets its pairs' counts back, and, for each first word,
   how many followers have pair counts 1 to 5, and, as whole numbers, what p(w) of the followers adds up to. For the frequent ones these are added up on the driver (at most 4 a range).
4. scores: each block looks up its tokens and adds up its documents.

All exchanged tables are written to the shared folder; a lost executor repeats a step at most. Counts of counts alone reach the driver.

Defined results: null and blank texts are one end token; repeated rows count and are scored each; without training texts every word is unknown (score and base are 0 for
n tokens of probability one); an empty table gives no rows; extra columns are ignored; very long texts are one row of a block, which may be larger than BLOCK_TOKENS by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_TOKENS = 1_000_000
#: Tokens whose pairs meet in one range: total / RANGES within these bounds.
RANGES, PART_TOKENS = 200, (1_000_000, 4_000_000)
#: Good-Turing discounts apply to counts up to K, the same way at every size.
K = 5
W_BITS = 40


def pack(a: np.ndarray) -> bytes:
    """An integer or float array, its bytes by place, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    dtype = np.dtype(data[:3].decode())  # as in "<u8"
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of an ascending array of hashes."""
    return np.diff(a, prepend=np.uint64(0))


def unsteps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint64)


def word_hashes(text: str | None, hasher) -> np.ndarray:
    """Hashes of the words (A-Z in lower case, split at the six ASCII white spaces) and of the end."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    w.append(b"\n")
    return np.fromiter(map(hasher, w), np.uint64, len(w))


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """W_BITS bits of the second word's hash, as they depend on the first."""
    with np.errstate(over="ignore"):
        x = (u ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD) + w
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x >> np.uint64(64 - W_BITS)


#: The hash that stands for the start of a text.
START = np.uint64(0x5BD1E995)


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash; ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# ---- step 1: blocks


def _blocks(kind: pa.DataType) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        task, made, hasher = TaskContext.get().partitionId(), 0, xxhash.xxh64_intdigest
        ids, held, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            lens = np.array([len(p) for p in parts])
            uniq, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            train = np.bincount(inverse, np.repeat(~np.array(held, bool), lens), len(uniq)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(uniq), np.int64)
            rank[order] = np.arange(len(uniq))
            row = [
                pa.array([task * 2**24 + made], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(narrow(lens))], pa.binary()),
                pa.array([pack(narrow(rank[inverse]))], pa.binary()), pa.array([pack(steps(uniq))], pa.binary()), pa.array([pack(narrow(counts))], pa.binary()), pa.array([pack(narrow(train))], pa.binary()),
                pa.array([int(lens.sum())], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "held", "lens", "seq", "uniq", "counts", "train", "n"])

        for b in batches:
            for i, h, t in zip(b.column("doc_id"), b.column("held"), b.column("text"), strict=True):
                x = word_hashes(t.as_py(), hasher)
                ids.append(i.as_py())
                held.append(bool(h.as_py()))
                parts.append(x)
                size += len(x)
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, held, parts, size, made = [], [], [], 0, made + 1
        if parts:
            yield block()

    return run


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The blocks as a table bucketed by block in the shared folder, so that later joins on block don't move it, and the number of buckets."""
    spark = docs.sparkSession
    field = docs.schema["doc_id"]
    kind = field.dataType
    texts = docs.select("doc_id", (common.crc_mod(F.col("doc_id"), 5) == 1).alias("held"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = f"block bigint, ids array<{kind.simpleString()}>, held array<boolean>, lens binary, seq binary, uniq binary, counts binary, train binary, n bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    made = texts.mapInArrow(common.lean(_blocks(to_arrow_type(kind))), schema)
    path = common.new_path(spark, "katz_blocks")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = max(1, min(20_000, math.ceil(size / (6 * BLOCK_TOKENS))))
    made.write.format("parquet").option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame knows the files and their buckets; nothing stays in the catalog
    return table, buckets


# ---- step 2: unigrams


def _send_words(parts: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, uniq, train in zip(b.column("block"), b.column("uniq"), b.column("train"), strict=True):
                u, t = unsteps(unpack(uniq.as_py())), unpack(train.as_py())
                ends = np.searchsorted(range_of(u, parts), np.arange(parts + 1))
                full = [p for p in range(parts) if ends[p] < ends[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block.as_py()] * len(full), pa.int64()), pa.array([pack(steps(u[ends[p] : ends[p + 1]])) for p in full], pa.binary()), pa.array([pack(t[ends[p] : ends[p + 1]]) for p in full], pa.binary())],
                    ["part", "block", "keys", "counts"],
                )

    return run


OUT = "kind string, part int, block bigint, a binary, b binary, c binary"


def _out(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "part", "block", "a", "b", "c"])


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    """How many have count 1 .. K + 1, all that were seen, and the sum of counts."""
    return np.concatenate([np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2], [(c > 0).sum()], [c.sum()]]).astype(np.int64)


def _merge_words(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    keys = [unsteps(unpack(x.as_py())) for x in table.column("keys")]
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack(x.as_py()) for x in table.column("counts")]), len(uniq)).astype(np.int64)
    rows, at = [("model", part, None, pack(steps(uniq[total > 0])), pack(narrow(total[total > 0])), None), ("stats", part, None, counts_of_counts(total).tobytes(), None, None)], 0
    for block, k in zip(table.column("block"), keys, strict=True):
        rows.append(("answer", part, block.as_py(), pack(narrow(total[inverse[at : at + len(k)]])), None, None))
        at += len(k)
    return _out(rows)


def smoothed(n: np.ndarray) -> float | None:
    """The slope of log n_r over log r, r = 1 .. K + 1, as in Simple Good-Turing: a count of zero is left out and its share goes to its neighbours."""
    r = np.flatnonzero(n > 0) + 1.0
    if len(r) < 2:
        return None
    gap = np.append(r[1:], 2 * r[-1] - np.append(0.0, r)[-2]) - np.append(0.0, r[:-1])
    x, y = np.log(r), np.log(2 * n[n > 0] / gap)
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def discounts(n: np.ndarray) -> list[float]:
    """d(1) .. d(K) from counts of counts, by Good-Turing as Katz uses it, over counts of counts smoothed by a log-log line.

    Raw ratios leave (0, 1) as soon as groups of copies raise one n_r; those of a line steeper than 1 / r never do. Only if there is no such line
    (fewer than two of n_1 .. n_K+1 are above zero, or they hardly fall) it is absolute discounting.
    """
    n = np.asarray(n[: K + 1], float)
    slope = smoothed(n)
    if slope is not None and slope < -1 - 1e-6:
        rest = (K + 1) ** (slope + 1)
        return [((1 + 1 / r) ** (slope + 1) - rest) / (1 - rest) for r in range(1, K + 1)]
    cut = float(n[0] / (n[0] + 2 * n[1])) if n[0] > 0 else 0.5
    cut = min(0.95, max(0.05, cut))
    return [(r - cut) / r for r in range(1, K + 1)]


class Unigrams:
    """The lower order: N, V, discounts and the unknown word's probability."""

    def __init__(self, stats: np.ndarray) -> None:
        self.n, self.v = int(stats[K + 2]), int(stats[K + 1])
        self.d = discounts(stats)
        lost = sum(r * float(stats[r - 1]) * (1 - self.d[r - 1]) for r in range(1, K + 1))
        # without any discounted count, the unknown word counts as half a token
        self.scale = 1.0 if lost > 0 else self.n / (self.n + 0.5)
        self.unknown = (lost / self.n if lost > 0 else 0.5 / (self.n + 0.5)) if self.n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        factor = np.concatenate([[1.0], self.d, [1.0]])[np.minimum(c, K + 1)]
        return np.where(c > 0, factor * c * self.scale / max(1, self.n), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


# ---- step 3: bigrams


class Block:
    """A block's tokens, distinct words (ascending hashes) and pairs."""

    def __init__(self, lens: bytes, seq: bytes, uniq: bytes, counts: bytes, held: list[bool]) -> None:
        self.lens = unpack(lens).astype(np.int64)
        self.held = np.array(held, bool)
        self.uniq = unsteps(unpack(uniq))
        order = np.argsort(-unpack(counts).astype(np.int64), kind="stable")
        self.tokens = order[unpack(seq)]
        # contexts: the token before; len(uniq) stands for the start
        first = np.cumsum(self.lens) - self.lens
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[first] = len(self.uniq)

    def word_counts(self, answers: list, parts: int) -> np.ndarray:
        by = {a["part"]: unpack(bytes(a["a"])) for a in answers}
        return np.concatenate([by[p] for p in sorted(by)]).astype(np.int64) if by else np.zeros(0, np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct pairs, of each token's pair, and how often a pair is in training texts."""
        code, inverse = np.unique(self.context * np.int64(len(self.uniq)) + self.tokens, return_inverse=True)
        train = np.bincount(inverse, np.repeat(~self.held, self.lens), len(code)).astype(np.int64)
        return code, inverse, train

    def dealt(self, code: np.ndarray, word_counts: np.ndarray, starts: int, parts: int, hot: int):
        """For each range: pair positions in order (first hash, second bits), and the pairs' hashes."""
        n = len(self.uniq)
        u, w = code // n, code % n
        first = np.append(self.uniq, START)[u]
        bits = mixed(first, self.uniq[w])
        often = np.append(word_counts, starts)[u]
        part = range_of(first, parts)
        salts = -(-often // hot)
        part = np.where(often > hot, (part + (bits % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64)) % parts, part)
        order = np.lexsort((bits, first, part))
        return order, part[order], first[order], bits[order], w[order], often[order] > hot


def _send_pairs(parts: int, starts: int, hot: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["lens"], r["seq"], r["uniq"], r["counts"], r["held"])
                known = block.word_counts(r["answers"], parts)
                code, _, train = block.pairs()
                order, part, first, bits, w, _ = block.dealt(code, known, starts, parts, hot)
                ends = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                # the second word's count is asked for by training pairs only
                second = np.where(train[order] > 0, known[w], 0)
                for p in np.flatnonzero(np.diff(ends)):
                    s = slice(ends[p], ends[p + 1])
                    heads, follow = np.unique(first[s], return_counts=True)
                    rows.append((int(p), r["block"], pack(steps(heads)), pack(narrow(follow)), np.ascontiguousarray(bits[s]).view(np.uint8).reshape(-1, 8)[:, : W_BITS // 8].tobytes(), pack(narrow(train[order[s]])), pack(narrow(second[s]))))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "heads", "follow", "bits", "counts", "words"])

    return run


def _merge_pairs(hot_hashes: np.ndarray) -> callable:
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        heads, follows, sizes = [], [], []
        for h, f in zip(table.column("heads"), table.column("follow"), strict=True):
            heads.append(unsteps(unpack(h.as_py())))
            follows.append(unpack(f.as_py()).astype(np.int64))
            sizes.append(int(follows[-1].sum()))
        first, head_at = np.unique(np.concatenate(heads), return_inverse=True)
        raw = np.frombuffer(b"".join(x.as_py() for x in table.column("bits")), np.uint8).reshape(-1, W_BITS // 8)
        bits = np.zeros((len(raw), 8), np.uint8)
        bits[:, : W_BITS // 8] = raw
        key = (np.repeat(head_at, np.concatenate(follows)).astype(np.int64) << W_BITS) | bits.view(np.int64).ravel()
        uniq, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(x.as_py()) for x in table.column("counts")]), len(uniq)).astype(np.int64)
        words = np.zeros(len(uniq), np.int64)
        np.maximum.at(words, at, np.concatenate([unpack(x.as_py()) for x in table.column("words")]).astype(np.int64))
        seen = np.flatnonzero(total > 0)
        head = (uniq >> W_BITS)[seen]
        known = words[seen]
        # what p(w) of the followers adds up to, in whole numbers: the sum of counts above K, and how many followers have each count up to K
        mass = np.bincount(head, np.where(known > K, known, 0), len(first)).astype(np.int64)
        few = np.zeros((len(first), 2 * K), np.int64)
        for r in range(1, K + 1):
            few[:, r - 1] = np.bincount(head, total[seen] == r, len(first))
            few[:, K + r - 1] = np.bincount(head, known == r, len(first))
        rows = [("model", part, None, pack(steps(first)), pack(steps(uniq[seen].view(np.uint64))), pack(narrow(total[seen]))), ("stats", part, None, counts_of_counts(total).tobytes(), None, None)]
        frequent = np.isin(first, hot_hashes)
        for i in np.flatnonzero(frequent):
            rows.append(("hot", part, None, first[i : i + 1].tobytes(), few[i].tobytes(), mass[i : i + 1].tobytes()))
        a = h = 0
        for block, hs, n in zip(table.column("block"), heads, sizes, strict=True):
            mine = head_at[h : h + len(hs)]
            mine = mine[~frequent[mine]]
            rows.append(("answer", part, block.as_py(), pack(narrow(total[at[a : a + n]])), pack(narrow(few[mine].ravel())), pack(narrow(mass[mine]))))
            a, h = a + n, h + len(hs)
        return _out(rows)

    return run


# ---- step 4: scores


def _score(low: Unigrams, d2: list[float], parts: int, starts: int, hot: int, hot_stats: dict[int, tuple[np.ndarray, int]], kind: pa.DataType) -> callable:
    keep, orders = 1 - np.array(d2), np.arange(1, K + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = Block(r["lens"], r["seq"], r["uniq"], r["counts"], r["held"])
                n = len(block.uniq)
                known = block.word_counts(r["answers"], parts)
                code, inverse, _ = block.pairs()
                order, part, first, _, _, frequent = block.dealt(code, known, starts, parts, hot)
                got = sorted(r["pairs"], key=lambda x: x["part"])
                count = np.empty(len(code), np.int64)
                count[order] = np.concatenate([unpack(bytes(x["a"])) for x in got])
                # first words in the order of the answers: by range, without the frequent ones
                few, mass = np.zeros((n + 1, 2 * K)), np.zeros(n + 1)
                ctx = (code // n)[order]
                new = np.ones(len(ctx), bool)
                new[1:] = (ctx[1:] != ctx[:-1]) | (part[1:] != part[:-1])
                at = ctx[new & ~frequent]
                few[at] = np.concatenate([unpack(bytes(x["b"])).reshape(-1, 2 * K) for x in got])
                mass[at] = np.concatenate([unpack(bytes(x["c"])) for x in got])
                for i in np.unique(ctx[frequent]):
                    few[i], mass[i] = hot_stats[int(np.append(block.uniq, START)[i])]
                often = np.append(known, starts).astype(np.float64)
                left = (few[:, :K] * orders * keep).sum(1)
                mass = (mass + (few[:, K:] * orders * low.d).sum(1)) * low.scale / max(1, low.n)
                # a context without discounted followers keeps one more token for what was not seen
                whole = np.where((left <= 0) & (often > 0), often + 1, np.maximum(often, 1))
                alpha = np.where(often > 0, np.where(left > 0, left, 1.0) / whole / np.maximum(1 - mass, 1e-300), 1.0)
                word_p = low.p(known)
                u, w = code // n, code % n
                factor = np.concatenate([[1.0], d2, [1.0]])[np.minimum(count, K + 1)]
                p = np.where(count > 0, factor * count / whole[u], alpha[u] * word_p[w])
                ends = np.cumsum(block.lens)
                total = np.add.reduceat(np.log10(p)[inverse], ends - block.lens)
                base = np.add.reduceat((low.base(known) if low.n else np.zeros(n))[block.tokens], ends - block.lens)
                seen = np.add.reduceat((known > 0)[block.tokens].astype(np.int64), ends - block.lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], kind), pa.array(block.held), pa.array(block.lens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _stats(table: DataFrame) -> np.ndarray:
    """Counts of counts, summed over the ranges: one row of K + 3 numbers a range."""
    total = np.zeros(K + 3, np.int64)
    for r in table.where("kind = 'stats'").select("a").collect():
        total += np.frombuffer(bytes(r["a"]), np.int64)
    return total


def _answers(table: DataFrame, buckets: int, *cols: str) -> DataFrame:
    """block and its answers, dealt as the blocks are, so that they move once: for the grouping and the join on block."""
    return table.where("kind = 'answer'").select("block", F.struct("part", *cols).alias("x")).repartition(buckets, "block").groupBy("block").agg(F.collect_list("x").alias("x"))


def written_by_kind(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = common.new_path(spark, name)
    schema = df.schema
    df.write.partitionBy("kind").parquet(path)
    return spark.read.schema(schema).parquet(path)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    table, buckets = blocks(docs)
    facts = table.agg(F.sum("n").alias("n"), F.sum(F.aggregate(F.transform("held", lambda h: F.when(h, 0).otherwise(1)), F.lit(0), lambda a, x: a + x)).alias("starts")).first()
    tokens, starts = facts["n"] or 0, facts["starts"] or 0
    size = min(max(PART_TOKENS[0], tokens // RANGES), PART_TOKENS[1])
    parts = max(1, math.ceil(tokens / size))
    words = table.select("block", "uniq", "train").mapInArrow(common.lean(_send_words(parts)), "part int, block bigint, keys binary, counts binary")
    uni = written_by_kind(words.groupBy("part").applyInArrow(_merge_words, OUT), "katz-unigrams")
    low = Unigrams(_stats(uni))
    hot = max(1, size // 4)
    # words more frequent than a quarter of a range: at most 4 a range
    frequent = [START] if starts > hot else []
    for r in uni.where("kind = 'model'").select("a", "b").mapInArrow(_frequent(hot), "h bigint").collect():
        frequent.append(np.uint64(r["h"] & (2**64 - 1)))
    state = ["block", "ids", "held", "lens", "seq", "uniq", "counts"]
    with_words = table.select(*state).join(_answers(uni, buckets, "a").withColumnRenamed("x", "answers"), "block")
    sent = with_words.drop("ids").mapInArrow(common.lean(_send_pairs(parts, starts, hot)), "part int, block bigint, heads binary, follow binary, bits binary, counts binary, words binary")
    bi = written_by_kind(sent.groupBy("part").applyInArrow(_merge_pairs(np.array(frequent, np.uint64)), OUT), "katz-bigrams")
    d2 = discounts(_stats(bi))
    hot_stats: dict[int, tuple] = {}
    for r in bi.where("kind = 'hot'").select("a", "b", "c").collect():
        h = int(np.frombuffer(bytes(r["a"]), np.uint64)[0])
        few, mass = hot_stats.get(h, (np.zeros(2 * K, np.int64), 0))
        hot_stats[h] = (few + np.frombuffer(bytes(r["b"]), np.int64), mass + int(np.frombuffer(bytes(r["c"]), np.int64)[0]))
    kind = docs.schema["doc_id"].dataType
    full = with_words.join(_answers(bi, buckets, "a", "b", "c").withColumnRenamed("x", "pairs"), "block")
    out = full.mapInArrow(common.lean(_score(low, d2, parts, starts, hot, hot_stats, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(low.n).cast("long").alias("train_tokens"), "base_score", "score")


def _frequent(hot: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("a"), b.column("b"), strict=True):
                found = unsteps(unpack(k.as_py()))[unpack(c.as_py()) > hot]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return run


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
