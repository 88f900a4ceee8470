"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages.

Every passage of PASSAGE words is encoded (character classes, word shapes, repetition), a gated attention learned from document labels weighs
the passages, and the weighted representation is scored. Trained on at most MAX_SIDE documents of either label, whole ones, with MAX_BYTES of text in all (smallest hash of doc_id first);
the encoding runs on the executors, the training, over bags of WIDTH numbers a passage, on the driver. Scoring is a narrow map that holds one document's passages at a time.

Defined results: null, empty and blank texts are one empty passage; very long texts are a bag of as many passages as they have; without training rows of both labels the score is 0.5; repeated rows are scored each, and of
rows with one doc_id the one whose text has the smallest hash is trained on; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names. Labels are read only for training rows and never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PASSAGE = 60
MAX_SIDE = 2_500
HIDDEN, GATE, EPOCHS = 24, 12, 60
THRESHOLD = 0.7
#: Bound of the training texts of either label together; a passage of them takes some 400 bytes and becomes WIDTH numbers on the driver.
MAX_BYTES = 200_000_000


def _classes() -> np.ndarray:
    """Character class of a byte: lower, upper, digit, blank, line end, stop or comma, !?, bar, rare sign, other sign, beyond ASCII."""
    table = np.full(256, 9, np.uint8)
    for i, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:", "!?", "|", "#*$%&<>"]):
        table[[ord(c) for c in chars]] = i
    table[128:] = 10
    return table


CLASS = _classes()
N_CLASS = 11
WIDTH = 2 * N_CLASS + 8


def _again(things: list[bytes]) -> np.ndarray:
    """1 for each that equals an earlier one, else 0."""
    first = dict(zip(reversed(things), range(len(things) - 1, -1, -1), strict=True))
    new = np.zeros(len(things))
    new[list(first.values())] = 1
    return 1 - new


def passages(text: str | None) -> np.ndarray:
    """One row of WIDTH numbers for each passage of the whole text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    cls = CLASS[np.frombuffer(data, np.uint8)]
    blank = (cls == 3) | (cls == 4)
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(start)
    first = np.arange(0, n, PASSAGE)
    count = np.diff(np.append(first, n)).astype(np.float64)
    cuts = start[first]
    out = np.zeros((len(first), WIDTH))
    size = np.diff(np.append(cuts, len(data))).astype(np.float64)
    last = cls[end - 1]
    for c in range(N_CLASS):
        out[:, c] = np.add.reduceat((cls == c).view(np.int8), cuts, dtype=np.int64) / size
        out[:, N_CLASS + c] = np.add.reduceat((last == c).view(np.int8), first, dtype=np.int64) / count
    k = 2 * N_CLASS
    length = (end - start).astype(np.float64)
    mean = np.add.reduceat(length, first) / count
    out[:, k] = np.log1p(mean)
    out[:, k + 1] = np.log1p(np.maximum.reduceat(length, first))
    out[:, k + 2] = np.add.reduceat((cls[start] == 1).view(np.int8), first, dtype=np.int64) / count
    for j, i in enumerate(first):
        w = words[i : i + PASSAGE]
        kinds = set(w)
        out[j, k + 3] = len(kinds) / len(w)
        out[j, k + 4] = sum(map(bytes.__eq__, w, w[1:])) / len(w)
    # of the lines that begin in a passage, how many the text had before, and the same of its words
    passage_of = lambda at: np.minimum(np.searchsorted(cuts, at, "right"), len(cuts)) - 1
    lines = data.split(b"\n")
    begin = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
    at = np.maximum(passage_of(begin), 0)
    out[:, k + 5] = np.bincount(at, _again(lines), len(first)) / np.maximum(1, np.bincount(at, minlength=len(first)))
    out[:, k + 6] = 1 - np.add.reduceat(_again(words), first) / count
    out[:, k + 7] = np.log1p(count) / np.log1p(PASSAGE)
    return out.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder tanh(xW+b), gates tanh(hV)*sigmoid(hU), attention softmax over a bag, logistic output."""

    names = ("W", "b", "V", "U", "q", "c", "d")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale = mean, scale
        self.W, self.b = r.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN)
        self.V, self.U = r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE))
        self.q, self.c, self.d = r.normal(0, 0.3, GATE), r.normal(0, 0.3, HIDDEN), np.zeros(1)

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        h = np.tanh(x @ self.W + self.b)
        t, s = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        e = (t * s) @ self.q
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ self.c + self.d[0])}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
        n = len(y)
        f = self.forward(x, bag, n)
        g = w * (f["p"] - y) / w.sum()
        dz = g[:, None] * self.c
        dzb = dz[bag]
        da = (f["h"] * dzb).sum(1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
        dt, ds = de[:, None] * self.q * f["s"], de[:, None] * self.q * f["t"]
        dv, du = dt * (1 - f["t"] ** 2), ds * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dzb + dv @ self.V.T + du @ self.U.T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "q": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rate: float = 0.01, decay: float = 1e-4, batch: int = 256, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        xs = [(b - self.mean) / self.scale for b in bags]
        w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        m = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.names}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                part = order[i : i + batch]
                bag = np.repeat(np.arange(len(part)), [len(xs[j]) for j in part])
                grad = self.gradient(np.concatenate([xs[j] for j in part]), bag, y[part], w[part])
                step += 1
                for k, g in grad.items():
                    value = getattr(self, k)
                    g = g + decay * value
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, value - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))

    def score(self, x: np.ndarray) -> float:
        return float(self.forward((x - self.mean) / self.scale, np.zeros(len(x), np.int64), 1)["p"][0])


def training(docs: DataFrame, labels: DataFrame, bound: int = MAX_SIDE, most: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, quality of the bounded sample: one row a doc_id, whole texts, in the order of the ids' hashes while they fit."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(common.crc_mod(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sides = [rows.where(F.col("quality") == v).orderBy(*order).limit(bound) for v in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # 2 x bound rows at most from here on
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("quality").orderBy(*order))
    return one.withColumn("_upto", upto).where(F.col("_upto") <= most // 2).drop("_upto")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [passages(t.as_py()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary()), b.column("quality")], ["doc_id", "x", "quality"])


def fit(docs: DataFrame, labels: DataFrame) -> Attention | None:
    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most 2 x MAX_SIDE bags of MAX_BYTES of text; sorted, so that the order of tasks has no influence
    got = training(docs, labels).select("doc_id", "text", "quality").mapInArrow(common.lean(_bags), f"doc_id {kind}, x binary, quality int").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["quality"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in got]
    every = np.concatenate(bags)
    model = Attention(every.mean(0), every.std(0) + 1e-2)
    model.fit(bags, y)
    return model


def scored(docs: DataFrame, model: Attention | None, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(passages(t.as_py())) if model else 0.5 for t in b.column("_scored")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(common.lean(run), f"{schema}, score double")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
