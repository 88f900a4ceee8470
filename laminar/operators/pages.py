"""Whole pages of boxes as arrays: which panel holds an item, which figures share a text's panel, by numpy over Arrow batches.

Rows come with a page's boxes one after the other; a batch ends where it likes, so its last page waits for the next one. Pairs of an item and the panels or figures of its page are
made PAIRS at a time and never leave the worker. Order of values as in SQL: NaN after all numbers, null after NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds as they are sent to workers; other boxes stay behind.
PANEL, TEXT, FIGURE = 0, 1, 2
#: Pairs at a time, few enough for a core's cache; and figures of texts in one batch handed back.
PAIRS, LISTED = 1 << 14, 1 << 20


def _differs(col: pa.Array) -> np.ndarray:
    """Whether a row's value differs from the one before, from the second row on; null equals null."""
    if pa.types.is_struct(col.type):
        return np.logical_or.reduce([col.is_null().to_numpy(False)[1:] != col.is_null().to_numpy(False)[:-1]] + [_differs(c) for c in col.flatten()])
    gone = col.is_null().to_numpy(False)
    return (gone[1:] != gone[:-1]) | pc.fill_null(pc.not_equal(col[1:], col[:-1]), False).to_numpy(False)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole pages, and the page's number within its batch for each row."""
    waiting: list[pa.RecordBatch] = []  # rows of one page, which may go on

    def numbered(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        return rows, np.concatenate([[0], np.cumsum(_differs(rows["page_id"]))])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = _differs(batch["page_id"])
        if waiting and _differs(pa.concat_arrays([waiting[-1]["page_id"][-1:], batch["page_id"][:1]]))[0]:
            new = np.concatenate([[True], new])
        else:
            new = np.concatenate([[False], new])
        cut = int(np.flatnonzero(new)[-1]) if new.any() else None
        if cut is None:
            waiting.append(batch)
            continue
        yield numbered(pa.concat_batches([*waiting, batch.slice(0, cut)]))
        waiting = [batch.slice(cut)]
    if waiting:
        yield numbered(pa.concat_batches(waiting))


class Boxes:
    """Boxes of one kind: their rows, pages, coordinates and centres; `gone` are masks of nulls."""

    def __init__(self, rows: pa.RecordBatch, page: np.ndarray, take: np.ndarray):
        order = pc.fill_null(rows["idx"].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(False)[take]
        take = take[np.lexsort((order, page[take]))]
        self.take, self.page = take, page[take]
        self.at, self.gone = {}, {}
        for k in "xywh":
            self.at[k] = rows[k].cast(pa.float64()).to_numpy(False)[take]
            self.gone[k] = rows[k].is_null().to_numpy(False)[take] if rows[k].null_count else np.zeros(len(take), bool)
        for c, k, size in (("cx", "x", "w"), ("cy", "y", "h")):
            self.at[c], self.gone[c] = self.at[k] + self.at[size] / 2, self.gone[k] | self.gone[size]

    def __len__(self) -> int:
        return len(self.take)


def _pairs(low: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(items, of, other, starts): pairs of items[of] and each of its `count` others from `low` on, PAIRS at a time; an item's pairs begin at `starts`. Items without others are left out."""
    some = np.flatnonzero(count)
    ends, i = np.cumsum(count[some]), 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        items = some[i:j]
        n = count[items]
        starts = np.cumsum(n) - n
        yield items, np.repeat(np.arange(len(items)), n), np.arange(n.sum()) - np.repeat(starts - low[items], n), starts
        i = j


def _least(of: np.ndarray, starts: np.ndarray, value: np.ndarray, other: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """The other with the least (level, value, other) of each item; `level` only where there are NaN."""
    if level is None:
        least = np.minimum.reduceat(value, starts)
        return np.minimum.reduceat(np.where(value == least.take(of), other, np.iinfo(np.int64).max), starts)
    return other[np.lexsort((other, value, level, of))[starts]]


def _between(items: Boxes, i: np.ndarray, panels: Boxes, j: np.ndarray, c: str, k: str, size: str) -> tuple[np.ndarray, np.ndarray]:
    """(yes, no) of centre c between the panel's edges along an axis; neither where a null leaves it open."""
    value, low, high = items.at[c][i], panels.at[k][j], panels.at[k][j] + panels.at[size][j]
    known = ~(items.gone[c][i] | panels.gone[k][j])
    both = known & ~panels.gone[size][j]
    above, below = (value >= low) | np.isnan(value), (value <= high) | np.isnan(high)
    return both & above & below, known & ~above | both & ~below


def panel_of(items: Boxes, panels: Boxes) -> np.ndarray:
    """Position among panels of the one that holds the item's centre, else of the one with the nearest centre, the first of equals; -1 on a page without panels."""
    found = np.full(len(items), -1, np.int64)
    low, high = np.searchsorted(panels.page, items.page, "left"), np.searchsorted(panels.page, items.page, "right")
    right, bottom = panels.at["x"] + panels.at["w"], panels.at["y"] + panels.at["h"]
    for which, of, j, starts in _pairs(low, high - low):
        i = which.take(of)
        cx, cy = items.at["cx"].take(i), items.at["cy"].take(i)
        dx, dy = panels.at["cx"].take(j) - cx, panels.at["cy"].take(j) - cy
        d = np.sqrt(dx * dx + dy * dy)  # as geometry.distance() writes it
        if not np.isnan(d).any():
            inside = (cx >= panels.at["x"].take(j)) & (cx <= right.take(j)) & (cy >= panels.at["y"].take(j)) & (cy <= bottom.take(j))
            found[which] = _least(of, starts, np.where(inside, -1.0, d), j)
            continue
        (in_x, out_x), (in_y, out_y) = _between(items, i, panels, j, "cx", "x", "w"), _between(items, i, panels, j, "cy", "y", "h")
        none = items.gone["cx"][i] | items.gone["cy"][i] | panels.gone["cx"][j] | panels.gone["cy"][j]
        level = np.select([in_x & in_y, ~(out_x | out_y), none], [0, 3, 2], 1)  # inside, unknown, outside without a distance, outside
        found[which] = _least(of, starts, np.where(level == 1, d, 0.0), j, level)
    return found


def _of_scope(texts: Boxes, text_panel: np.ndarray, figures: Boxes, figure_panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures in order of their panel, and for each text where those of its panel begin and how many there are; on a page without panels all share one."""
    scope = np.where(figure_panel < 0, -1 - figures.page, figure_panel)
    order = np.argsort(scope, kind="stable")
    own = np.where(text_panel < 0, -1 - texts.page, text_panel)
    low, high = np.searchsorted(scope[order], own, "left"), np.searchsorted(scope[order], own, "right")
    return order, low, high - low


def _extent(rows: pa.RecordBatch, page: np.ndarray, use: np.ndarray, k: str, size: str) -> np.ndarray:
    """For each page the farthest edge of the rows in use; 1 where there are none."""
    edge, gone = rows[k].cast(pa.float64()).to_numpy(False) + rows[size].cast(pa.float64()).to_numpy(False), (rows[k].is_null().to_numpy(False) | rows[size].is_null().to_numpy(False))
    out = np.full(int(page[-1]) + 1, -np.inf)
    some = use & ~gone
    np.maximum.at(out, page[some], edge[some])
    has = np.zeros(len(out), bool)
    has[page[some]] = True
    return np.where(has, out, 1.0)


def _at(col: pa.Array, where: np.ndarray) -> pa.Array:
    """Values at positions, null at negative ones."""
    return col.take(pa.array(where, pa.int64(), mask=where < 0))


def _diagonal(rows: pa.RecordBatch, page: np.ndarray, kind: np.ndarray, texts: Boxes, text_panel: np.ndarray, panels: Boxes) -> np.ndarray:
    """Each text's panel's diagonal; its page's where there is no panel or that is 0 or null."""
    width, height = (_extent(rows, page, (kind == PANEL) | (kind == TEXT), k, size) for k, size in (("x", "w"), ("y", "h")))
    whole_page = np.sqrt(width * width + height * height)[texts.page]
    if not len(panels):
        return whole_page
    own = np.sqrt(panels.at["w"] * panels.at["w"] + panels.at["h"] * panels.at["h"])
    use = (text_panel >= 0) & ~(panels.gone["w"] | panels.gone["h"] | (own == 0))[text_panel]
    return np.where(use, own[text_panel], whole_page)


def near_texts(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches (page_id, kind, idx, x, y, w, h and, for `_figures`, tail) that gives the columns named for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, page in whole(batches):
            kind = rows["kind"].to_numpy(False)
            panels, texts, figures = (Boxes(rows, page, np.flatnonzero(kind == k)) for k in (PANEL, TEXT, FIGURE))
            if not len(texts):
                continue
            text_panel = panel_of(texts, panels)
            order, low, count = _of_scope(texts, text_panel, figures, panel_of(figures, panels))

            near, distance = np.full(len(texts), -1, np.int64), np.full(len(texts), np.nan)
            for which, of, other, starts in _pairs(low, count):
                i, j = which[of], order[other]
                dx, dy = figures.at["cx"].take(j) - texts.at["cx"].take(i), figures.at["cy"].take(j) - texts.at["cy"].take(i)
                d = np.sqrt(dx * dx + dy * dy)
                level = texts.gone["cx"][i] | texts.gone["cy"][i] | figures.gone["cx"][j] | figures.gone["cy"][j] if np.isnan(d).any() else None
                best = _least(of, starts, d, other, level)
                near[which] = order[best]
                distance[which] = d[starts + best - low[which]]
            far = np.where(near < 0, 0, near)
            unknown = (near < 0) | texts.gone["cx"] | texts.gone["cy"] | ((figures.gone["cx"] | figures.gone["cy"])[far] if len(figures) else True)

            idx = rows["idx"]
            columns = {k: rows[k].take(pa.array(texts.take)) for k in names if k in rows.schema.names}
            columns |= {"panel_idx": _at(idx.take(pa.array(panels.take)), text_panel), "near_idx": _at(idx.take(pa.array(figures.take)), near), "distance": pa.array(distance, mask=unknown)}
            if "diagonal" in names:
                columns["diagonal"] = pa.array(_diagonal(rows, page, kind, texts, text_panel, panels))
            if "_figures" not in names:
                yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)
                continue
            # figures go along only with texts that have a tail, LISTED in a batch
            n = np.where(rows["tail"].is_null().to_numpy(False)[texts.take], 0, count)
            ends, i, who = np.cumsum(n), 0, idx.take(pa.array(figures.take))
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LISTED, "right")))
                offsets = np.concatenate([[0], np.cumsum(n[i:j])])
                pos = order[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low[i:j], n[i:j])]
                at = pa.StructArray.from_arrays([pa.array(figures.at[k][pos], mask=figures.gone[k][pos]) for k in ("cx", "cy")], ["x", "y"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([who.take(pa.array(pos)), at], ["idx", "at"]))
                part = {k: v[i:j] for k, v in columns.items()} | {"_figures": lists}
                yield pa.RecordBatch.from_arrays([part[k] for k in names], names=names)
                i = j

    return run
