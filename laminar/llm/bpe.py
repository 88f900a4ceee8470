"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton over the reversed tokens finds, in one pass over a reversed piece, the longest token that starts at
every byte. The encoder takes the longest match, and keeps it only if the pair with the token before it is compatible: merging
the two tokens' bytes from scratch would give just these two tokens. If no shorter prefix token fits either, it
steps back and marks the position as dead, so every position is given up at most once and the time stays linear.
The pair-compatibility table is filled as pairs occur and is bounded, as is the table of pieces seen before.

Defined results: null text is the empty text, which has no tokens; a special token's string inside a text is that token; repeated rows
and extra columns have no influence; very long texts are encoded piece by piece, and a piece without a gap is as exact at any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Entries of a worker's tables of pieces and of pairs. A full table of pieces becomes the old one, whose entries come back when they are met; one of pairs is emptied.
CACHE = 200_000
#: Longer pieces are not remembered.
CACHED_CHARS = 40


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file; made once in every worker."""

    def __init__(self, spec: bytes) -> None:
        import ahocorasick
        import regex

        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        raw = [b""] * size
        for t, i in vocab.items():
            raw[i] = t.encode() if t in special else bytes(back[c] for c in t)
        for t, i in special.items():
            raw[i] = t.encode()
        self.length = [len(x) for x in raw]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        # the pattern of byte-level pre-tokenisation (a fixed value)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        ordinary = {raw[i]: i for t, i in vocab.items() if t not in special}
        # rank of a merge, by the pair; and the parts of each merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: list[int] = [-1] * size
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair], self.made[pair] = r, whole
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = pair, r
        self.shorter: dict[int, int] = {}
        for b, i in ordinary.items():
            self.shorter[i] = next((ordinary[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ordinary), -1)
        self.automaton = ahocorasick.Automaton()
        for b, i in ordinary.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.vocab = ordinary
        self.compatible: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE over the joined bytes of a and b ends with just a, b."""
        if (known := self.compatible.get((a, b))) is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            known = self.compatible[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo merges from the last one on: at any time the seam lies between the right edge x of a and the left
        # edge y of b; a merge across the seam that would have come before the next merge on either side breaks the pair.
        x, y, before = a, b, len(self.rank) + 1
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < before:
                return False
            rx, ry = self.order[x], self.order[y]
            if rx < 0 and ry < 0:
                return True
            # equal ranks cannot be on both sides of a merge across; the left one is applied first, the right one undone first
            if rx > ry:
                before, x = rx, self.parts[x][1]
            else:
                # a merge across of the same rank would come earlier in the text than the one in b
                before, y = ry + 1, self.parts[y][0]

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each byte."""
        n, found = len(piece), [-1] * len(piece)
        length = self.length
        for end, i in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if found[at] < 0 or length[i] > length[found[at]]:
                found[at] = i
        return found

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.vocab.get(data)
        if whole is not None:
            return (whole,)
        best, alive = self.longest(data), bytearray(b"\1" * (len(data) + 1))
        ids: list[int] = []
        length, shorter, fits = self.length, self.shorter, self.fits
        pos, n, token = 0, len(data), best[0]
        while pos < n:
            end = pos + length[token]
            if alive[end] and (not ids or fits(ids[-1], token)):
                ids.append(token)
                pos = end
                if pos < n:
                    token = best[pos]
                continue
            token = shorter[token]
            while token < 0:
                # nothing fits here: this position is dead, try a shorter token in place of the one before
                alive[pos] = 0
                token = ids.pop()
                pos -= length[token]
                token = shorter[token]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for p in self.pieces(part):
                ids = seen.get(p)
                if ids is None:
                    ids = self.old.get(p) or self.piece(p)
                    if len(p) <= CACHED_CHARS:
                        if len(seen) >= CACHE:
                            self.old, self.seen = seen, {}
                            seen = self.seen
                        seen[p] = ids
                out += ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        ids = np.asarray(ids, np.int64)
        out = []
        for i in range(0, len(ids), 65_536):
            part = ids[i : i + 65_536]
            start = self.offset[part]
            size = self.offset[part + 1] - start
            first = np.cumsum(size) - size
            out.append(self.blob[np.repeat(start - first, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


_MADE: dict[bytes, Bpe] = {}


def coder(spec: bytes) -> Bpe:
    key = hashlib.sha256(spec).digest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(spec)
    return _MADE[key]


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver: about 1.5 MB, a size that the tokenizer fixes; it goes to the workers as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _digests(spec, with_ids: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for b in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for x in b.column("text"):
                ids = np.array(bpe.encode(x.as_py() or ""), "<u4")
                n.append(len(ids))
                if with_ids:
                    kept.append(ids)
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    return run


def _tokens(spec) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for b in batches:
            ids = [bpe.encode(x.as_py() or "") for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])

    return run


def _texts(spec) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for b in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return run


def encode(docs: DataFrame, vocab: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, ids array<int>: the tokens of `text`. A narrow map: no shuffle, one batch of rows in memory at a time."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab or default_path()))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(common.lean(_tokens(spec)), f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, vocab: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, text: the text of `ids`."""
    spec = tokens.sparkSession.sparkContext.broadcast(vocabulary(vocab or default_path()))
    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "ids").mapInArrow(common.lean(_texts(spec)), f"`{key}` {kind}, text string")


def digests(docs: DataFrame, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and, asked for, ids: each text is encoded and decoded in one pass and, without ids, only the digests leave the worker."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab or default_path()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.lean(_digests(spec, with_ids)), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
