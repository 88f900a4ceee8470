"""Layout of a page: which panel holds an item, page extents, reading order.

Boxes come as a table (page_id, kind, idx, x, y, w, h). The panels of a page are gathered to one array, and items are joined to it by page: one
shuffle on page_id, and no row for every pair of item and panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.functions import geometry as G

BOX = ["x", "y", "w", "h"]


def boxes_by(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys -> out: array of (idx, x, y, w, h) by idx."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", *BOX))).alias(out))


def nearest_panel(panels: Column, p: Column) -> Column:
    """(outside, distance, idx) of the panel that a point belongs to: the first that contains it, else the one with the nearest centre, the first of equals."""
    rank = lambda b: F.struct(
        (~G.contains(b, p)).alias("outside"), F.when(G.contains(b, p), G.num(0)).otherwise(G.distance(G.center(b), p)).alias("distance"), b["idx"].alias("idx")
    )
    return F.array_min(F.transform(panels, rank))


def assign_to_panel(items: DataFrame, panels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds panel_idx and inside to items; both null on a page without panels."""
    by_page = boxes_by(panels, ["page_id"], "_panels")
    found = items.join(by_page, "page_id", "left").withColumn("_hit", nearest_panel(F.col("_panels"), G.center(F.struct(*BOX))))
    cols = keep or items.columns
    return found.select(*cols, F.col("_hit.idx").alias("panel_idx"), (~F.col("_hit.outside")).alias("inside"))


def extent() -> list[Column]:
    """width and height of the panels and texts of a group; 1 each where there are none."""
    use = F.col("kind").isin("panel", "text")
    right, bottom = F.max(F.when(use, F.col("x") + F.col("w"))), F.max(F.when(use, F.col("y") + F.col("h")))
    return [F.coalesce(right, G.num(1)).alias("width"), F.coalesce(bottom, G.num(1)).alias("height")]


def page_extent(boxes: DataFrame) -> DataFrame:
    """page_id, width, height, diagonal of panels and texts; 1 each where there are none (a page with neither)."""
    return boxes.groupBy("page_id").agg(*extent()).withColumn("diagonal", G.diagonal(F.col("width"), F.col("height")))


def row_order(panels: Column, direction: str = "auto", least_overlap: float = 0.3) -> Column:
    """Panels (idx, x, y, w, h) in reading order.

    In order of (middle height, idx), a panel joins the first row of which any panel overlaps it by `least_overlap` of the lower height; else it begins a row.
    Rows are read from the top, panels of a row by x. An aggregate() over the page's array: rows depend on the rows before.
    """
    if direction not in ("auto", "ltr", "rtl"):
        raise ValueError(f"unknown direction {direction!r}")
    seen = F.sort_array(F.transform(panels, lambda b: F.struct((b["y"] + b["h"] / 2).alias("cy"), b["idx"].alias("idx"), *[b[k].alias(k) for k in BOX])))
    kind = "array<struct<row:int,cy:double,idx:bigint,x:double,y:double,w:double,h:double>>"

    def step(acc: Column, b: Column) -> Column:
        met = F.filter(acc, lambda a: G.y_overlap(a, b) >= G.num(least_overlap))
        new = F.coalesce(F.array_max(F.transform(acc, lambda a: a["row"])), F.lit(-1)) + 1
        row = F.coalesce(F.array_min(F.transform(met, lambda a: a["row"])), new)
        return F.concat(acc, F.array(F.struct(row.alias("row"), b["cy"].alias("cy"), b["idx"].cast("bigint").alias("idx"), *[b[k].cast("double").alias(k) for k in BOX])))

    rows = F.aggregate(seen, F.array().cast(kind), step)
    sign = -1.0 if direction == "rtl" else 1.0

    def place(rows: Column) -> Column:
        top = lambda r: F.array_min(F.transform(F.filter(rows, lambda a: a["row"] == r["row"]), lambda a: a["y"]))
        return F.sort_array(F.transform(rows, lambda r: F.struct(top(r).alias("top"), r["row"].alias("row"), (r["x"] * sign).alias("along"), r["cy"].alias("cy"), r["idx"].alias("idx"))))

    # a one-element array binds the folded rows, so that they are folded once
    return F.flatten(F.transform(F.array(rows), place))


def reading_order(panels: DataFrame, direction: str = "auto") -> DataFrame:
    """page_id, idx, reading_order_index (0-based, dense)."""
    by_page = boxes_by(panels, ["page_id"], "_panels")
    placed = by_page.select("page_id", F.posexplode(row_order(F.col("_panels"), direction)).alias("reading_order_index", "_p"))
    return placed.select("page_id", F.col("_p.idx").alias("idx"), F.col("reading_order_index"))
