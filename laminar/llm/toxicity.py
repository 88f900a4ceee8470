"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding: compatibility forms (wide, mathematical, ligatures) and accents to the plain letter, A-Z to lower case, what has no width away, lookalike letters of other scripts and digits or signs that stand for letters to the
Latin letter, three or more of a letter to one, single letters in a row to a word, everything that is no letter to a space. Lexicon entries are whole words of any length (` idiot `) or word beginnings (` vequ`), learned
from labelled rows: those of MAX_SIDE toxic and MAX_SIDE clean training texts (distinct ones, so that copies count once; smallest hash of doc_id first) whose document frequency is more than chance. Counting is a Spark
aggregation; only patterns frequent enough to pass that test reach the driver, and all that pass are entries. A match inside an exception phrase, a parameter, doesn't count. The score is a logistic function of
the summed weights and of the weights per 100 words.

Defined results: null and empty texts match nothing and get the score of a text without matches; labels are read only for training rows and never enter a
score; without toxic or clean training rows the lexicon is empty and the score 0; repeated rows are scored each; an empty table gives no rows; very long texts are scored whole;
entries that tie are taken longest first, then in order of their letters; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample: distinct labelled texts of either kind.
MAX_SIDE = 3_000
#: Lengths of word beginnings that may be entries; whole words may have any length.
PREFIX = (4, 30)
#: Least log odds of an entry, and least share of its documents in which its neighbours differ.
PURE, VARIED = 1.5, 0.6
#: Bound of the expected number of entries by chance, and weights that count as the same.
SURE, NEARLY = 0.05, 0.7
THRESHOLD = 0.7
#: Phrases in which a lexicon word is meant literally (fixed values).
EXCEPTIONS = ["clown fish", "trash bag", "trash bin", "trash can"]

#: Letters that look like Latin ones (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ｏ": "o",
}
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0x300, 0x370), *range(0xFE00, 0xFE10)])
    table |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1}
    table |= {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return table


FOLD = _table()
LEET = str.maketrans(SUBSTITUTES)
#: Whole words that hold both a letter and a digit or sign, to which substitutes apply; numbers stay numbers.
MIXED = re.compile(r"(?<![\w@$])(?=[\w@$]*[013457@8$])(?=[\w@$]*[^\W\d_])[\w@$]+")
NO_LETTER = re.compile(r"[\W\d_]+")
#: Strokes between letters that aren't i themselves stand for i; three or more of a letter for one; single letters with the same sign or blank between them are a word.
STROKE = re.compile(r"(?<=[^\W\d_i])[!|](?=[^\W\d_i])")
LONG = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")


def fold(text: str | None) -> str:
    """Folded words, a space before and after each."""
    t = text or ""
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKD", t).translate(FOLD)
    t = MIXED.sub(lambda m: m[0].translate(LEET), t)
    if "!" in t or "|" in t:
        t = STROKE.sub("i", t)
    t = SPACED.sub(lambda m: m[0][::2], LONG.sub(r"\1", t))
    return f" {NO_LETTER.sub(' ', t).strip()} "


def candidates(folded: str) -> set[str]:
    """Patterns of a document: its words and their beginnings."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(PREFIX[0], min(PREFIX[1], len(w)) + 1))
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic"), strict=True):
            found = sorted(candidates(fold(text.as_py())))
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic.as_py()] * len(part), pa.int32())], ["pattern", "toxic"])


def _contexts(patterns: list[str]) -> callable:
    """pattern, context: the words before and after the first match in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        made = ahocorasick.Automaton()
        for p in patterns:
            made.add_word(p, p)
        made.make_automaton()
        for b in batches:
            rows: list[tuple[str, str]] = []
            for text in b.column("text"):
                t, seen = fold(text.as_py()), set()
                for end, p in made.iter(t):
                    if p not in seen:
                        seen.add(p)
                        start = end - len(p) + 1
                        before, after = t.rfind(" ", 0, start), t.find(" ", end + 1)
                        rows.append((p, t[before + 1 : start] + "|" + t[end + 1 : after if after >= 0 else None]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["pattern", "context"])

    return run


class Lexicon:
    """Weights by pattern, exception phrases and the logistic coefficients; a few thousand short strings at most."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coef: tuple[float, ...] = (-9.0, 1.0, 1.0, 1.0, 0.0)) -> None:
        self.weights, self.exceptions, self.coef = weights, exceptions, coef
        self._made = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "coef": self.coef, "_made": None}

    @property
    def automaton(self):
        if self._made is None:
            import ahocorasick

            self._made = ahocorasick.Automaton()
            for p in {*self.weights, *self.exceptions}:
                self._made.add_word(p, (p, len(p)))
            self._made.make_automaton()
        return self._made

    def features(self, text: str | None) -> tuple[float, ...]:
        """log of the summed weights and of those per 100 words, the heaviest match, the square root of the summed weights per square root of the words."""
        if not self.weights:
            return 0.0, 0.0, 0.0, 0.0
        t = fold(text)
        hits, free = [], []
        for end, (p, n) in self.automaton.iter(t):
            if p in self.weights:
                hits.append((end - n + 1, end, self.weights[p]))
            if p in self.exceptions:
                free.append((end - n + 1, end))
        total, word, top = 0.0, -1, 0.0
        best = 0.0
        for start, end, w in sorted(hits):
            if any(a <= start and end <= b for a, b in free):
                continue
            top = max(top, w)
            if start == word:  # of the entries that a word matches, the heaviest
                best = max(best, w)
                continue
            total += best
            word, best = start, w
        total += best
        n = max(1, t.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / n), top, total / math.sqrt(n)

    def score(self, x: tuple[float, ...]) -> float:
        if not self.weights:
            return 0.0
        z = self.coef[0] + sum(c * v for c, v in zip(self.coef[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_h, _n, toxic, first: the distinct texts of training rows, by hash and size, and of each the doc_id whose hash is smallest. A text with both labels is one of either kind."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(common.crc_mod(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("_n")).join(rows, "doc_id")
    return known.groupBy("_h", "_n", "toxic").agg(F.min(F.struct(F.xxhash64("doc_id").alias("order"), "doc_id")).alias("first"))


def training(docs: DataFrame, texts: DataFrame, bound: int = MAX_SIDE) -> DataFrame:
    """doc_id, text, toxic of the bounded sample of labelled_texts(), each text once: they are chosen by their hashes alone and broadcast (2 x bound short rows)."""
    sides = [texts.where(F.col("toxic") == v).orderBy("first", "_h", "_n").limit(bound) for v in (0, 1)]
    sample = sides[0].unionByName(sides[1]).select("first.doc_id", "_h", "_n", "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where((F.xxhash64("text") == F.col("_h")) & (F.coalesce(F.octet_length("text"), F.lit(-1)) == F.col("_n")))
    return found.dropDuplicates(["_h", "_n", "toxic"]).select("doc_id", "text", "toxic")


def chance(a: int, b: int, share: float) -> float:
    """Probability of a or more toxic among a + b documents, if each is toxic by `share`."""
    n = a + b
    if n > 2000:  # normal tail; far beyond any threshold here
        z = (a - 0.5 - n * share) / math.sqrt(n * share * (1 - share))
        return 0.5 * math.erfc(z / math.sqrt(2))
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(a, n + 1)]
    return sum(map(math.exp, logs))


def chosen(counts: DataFrame, toxic: DataFrame, n1: int, n0: int) -> dict[str, float]:
    """The lexicon from pattern counts(pattern, a: toxic documents, b: clean ones) and the toxic documents.

    An entry is more frequent in toxic documents than chance explains, given how many patterns were tried, and occurs between different words: what occurs
    in one context only comes from copies of one document.
    """
    tried, share = counts.count(), n1 / (n1 + n0)
    # what fewer toxic documents than this have passes the test below in no case
    least = max(3, math.ceil(math.log(max(1, tried) / SURE) / -math.log(share)))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1) * F.lit(n0 + 1) / (F.col("b") + 0.5))
    rows = counts.where(F.col("a") >= least).withColumn("w", odds).where(F.col("w") >= PURE).collect()
    rows = [r for r in rows if chance(r["a"], r["b"], share) * max(1, tried) < SURE]
    if not rows:
        return {}
    met = toxic.mapInArrow(common.lean(_contexts([r["pattern"] for r in rows])), "pattern string, context string").groupBy("pattern").agg(F.count_distinct("context").alias("n"))
    contexts = {r["pattern"]: r["n"] for r in met.collect()}
    # a beginning that one longer pattern accounts for adds nothing
    further: dict[str, int] = {}
    for r in rows:
        p = r["pattern"]
        for k in range(2, len(p)):
            further[p[:k]] = max(further.get(p[:k], 0), r["a"])
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (-r["a"], -len(r["pattern"]), r["pattern"])):
        p, w = r["pattern"], min(8.0, r["w"])
        if contexts.get(p, 0) < VARIED * r["a"] or further.get(p, 0) >= 0.9 * r["a"]:
            continue
        # a longer pattern adds something only if it is clearly purer than a beginning of it
        if all(w > kept[p[:k]] + NEARLY for k in range(2, len(p)) if p[:k] in kept):
            kept[p] = w
    return kept


def fit(docs: DataFrame, labels: DataFrame, exceptions: list[str] = EXCEPTIONS) -> Lexicon:
    texts = common.written(labelled_texts(docs, labels), "toxicity-texts")
    rows = common.written(training(docs, texts), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, [])
    pairs = rows.select("text", "toxic").mapInArrow(common.lean(_candidates), "pattern string, toxic int")
    counts = pairs.groupBy("pattern").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).where("a + b >= 3")
    counts = common.written(counts, "toxicity-patterns")
    lexicon = Lexicon(chosen(counts, rows.where("toxic = 1").select("text"), sizes[1], sizes[0]), [fold(e) for e in exceptions])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([list(v) for v in x], pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(common.lean(measured), "x array<double>, toxic int").collect()  # a few numbers a sample row
    got = sorted((list(r["x"]), r["toxic"]) for r in got)
    full = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    y = np.array([t for _, t in got], float)
    # the sample's halves weigh as all labelled texts do
    weight = np.where(y == 1, full[1] / max(1, y.sum()), full[0] / max(1, (1 - y).sum()))
    lexicon.coef = logistic(np.array([x for x, _ in got]), y, weight / weight.mean())
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Weighted logistic regression with a ridge, by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a.T * (w * p * (1 - p))) @ a + penalty, a.T @ (w * (y - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """`keep` columns and score: a narrow map with the lexicon in its closure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [lexicon.score(lexicon.features(t.as_py())) for t in b.column("_scored")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(common.lean(run), f"{schema}, score double")


def clean_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of `docs`, whatever their columns, that are not predicted toxic."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")

    out = scored(packed, lexicon, ["_row"])
    return out.where(F.col("score") < THRESHOLD).select("_row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
