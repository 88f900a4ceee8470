"""Page scans to rasters and crops, on executors: PNG and PNM by numpy and zlib, anything else by Pillow where it is installed.

A raster is a row (height, width, channels, data): rows of pixels, channels gray or red, green, blue.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Weights of red, green and blue in brightness (fixed values of ITU-R BT.601).
LUMA = np.array([0.299, 0.587, 0.114])
PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of a pixel by PNG colour type (fixed values); palettes are left to Pillow.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _undone(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG row without its filter: 0 none, 1 left, 2 above, 3 their mean, 4 the nearest of left, above and corner."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out = line.astype(int).tolist()
    up = above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            guess = min((left, up[i], corner), key=lambda c, t=left + up[i] - corner: abs(t - c))
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head = len(PNG), [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        return None
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out, above = np.empty((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for y in range(height):
        above = out[y] = _undone(int(rows[y, 0]), rows[y, 1:], above, n)
    return out.reshape(height, width, n)


def _pnm(data: bytes) -> np.ndarray | None:
    words, at = [], 0
    while len(words) < 4 and at < len(data):
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at) % (len(data) + 1)
        elif end > at:
            words.append(data[at:end])
        at = end + 1
    if len(words) < 4 or words[3] != b"255":
        return None
    n = 3 if words[0] == b"P6" else 1
    width, height = int(words[1]), int(words[2])
    return np.frombuffer(data, np.uint8, width * height * n, at).reshape(height, width, n)


def decoded(data: bytes | None) -> np.ndarray | None:
    """height x width x 1 or 3; null if it is no image that can be read here."""
    try:
        found = _png(data) if data and data.startswith(PNG) else _pnm(data) if data and data[:2] in (b"P5", b"P6") else None
        if found is None and data:
            from PIL import Image

            found = np.array(Image.open(io.BytesIO(data)).convert("RGB"))
    except (ImportError, OSError, ValueError, zlib.error, struct.error):
        return None
    return None if found is None else found[:, :, : 3 if found.shape[2] >= 3 else 1]


def gray(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0] if image.shape[2] == 1 else np.rint(image @ LUMA).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG of height x width x 1 or 3."""
    height, width, n = image.shape
    rows = np.zeros((height, 1 + width * n), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def rasters(pages: DataFrame) -> DataFrame:
    """pages(comic_id, page_id, content) -> comic_id, page_id, height, width, gray (one byte a pixel); pages that can't be read have nulls. One page in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                image = decoded(r.content)
                size = (None, None, None) if image is None else (*image.shape[:2], gray(image).tobytes())
                yield pd.DataFrame([(r.comic_id, r.page_id, *size)], columns=["comic_id", "page_id", "height", "width", "gray"]).astype({"height": "Int32", "width": "Int32"})

    return pages.select("comic_id", "page_id", "content").mapInPandas(run, "comic_id string, page_id string, height int, width int, gray binary")


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes(comic_id, page_id, name, x, y, w, h; whole numbers) -> comic_id, page_id, name, png of the clamped part of the page; empty parts go."""
    from pyspark.sql import functions as F

    by_page = boxes.groupBy("comic_id", "page_id").agg(F.collect_list(F.struct("name", "x", "y", "w", "h")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                image = decoded(r.content)
                rows = []
                for b in r.boxes if image is not None else []:
                    part = image[max(0, b["y"]) : max(0, b["y"] + b["h"]), max(0, b["x"]) : max(0, b["x"] + b["w"])]
                    if part.size:
                        rows.append((r.comic_id, r.page_id, b["name"], png(part)))
                yield pd.DataFrame(rows, columns=["comic_id", "page_id", "name", "png"])

    joined = pages.select("comic_id", "page_id", "content").join(by_page, ["comic_id", "page_id"])
    return joined.mapInPandas(run, "comic_id string, page_id string, name string, png binary")
