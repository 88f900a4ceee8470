"""Who speaks a bubble: the figure its tail points at, else the nearest one in the same panel.

Boxes are dealt and ordered by page once, and texts meet panels and figures as numpy arrays of some pages at a time. Ties: by the tail, the last figure; by distance, the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.shipping import ship

from . import layout, pages

MAX_ANGLE = 60.0


def tails_of(pairs: DataFrame, tails: DataFrame) -> DataFrame:
    """pairs(page_id, ord, text_idx, tail_idx), tails(page_id, idx, x, y, w, h) -> page_id, idx (of the text), tail (point): of several pairs of a text the last counts."""
    last = pairs.groupBy("page_id", "text_idx").agg(F.max_by("tail_idx", "ord").alias("tail_idx"))
    at = tails.select("page_id", F.col("idx").alias("tail_idx"), G.center(F.struct(*layout.BOX)).alias("tail"))
    return last.join(at, ["page_id", "tail_idx"]).select("page_id", F.col("text_idx").alias("idx"), "tail")


def by_tail(figures: Column, bubble: Column, tail: Column, limit: float = MAX_ANGLE) -> Column:
    """(angle, minus, idx) of the figure (idx, at: its centre) in the direction of the tail, or null."""
    c = G.center(bubble)
    scored = F.transform(figures, lambda f: F.struct(G.angle(tail["x"] - c["x"], tail["y"] - c["y"], f["at"]["x"] - tail["x"], f["at"]["y"] - tail["y"]).alias("angle"), (-f["idx"]).alias("minus"), f["idx"].alias("idx")))
    return F.array_min(F.filter(scored, lambda s: s["angle"] <= G.num(limit)))


def bubble_type(tail: Column) -> Column:
    return F.when(tail.isNotNull(), "speech").otherwise("narration")


def _over_pages(boxes: DataFrame, names: list[str]) -> DataFrame:
    """The columns named of pages.near_texts(), a row for each text. Boxes that are dealt and sorted by page are neither dealt nor sorted again."""
    ship(boxes.sparkSession)
    code = F.when(F.col("kind") == "panel", pages.PANEL).when(F.col("kind") == "text", pages.TEXT).when(F.col("kind") == "character", pages.FIGURE).cast("tinyint")
    dealt = boxes.where("page_id is not null and kind in ('panel', 'text', 'character')").repartition("page_id").sortWithinPartitions("page_id")
    sent = dealt.select("page_id", code.alias("kind"), "idx", *layout.BOX, *(["tail"] if "_figures" in names else []))
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    kinds |= {"panel_idx": kinds["idx"], "near_idx": kinds["idx"], "distance": "double", "diagonal": "double", "_figures": f"array<struct<idx:{kinds['idx']},at:struct<x:double,y:double>>>"}
    return sent.mapInArrow(pages.near_texts(names), ", ".join(f"{c} {kinds[c]}" for c in names))


def nearest(boxes: DataFrame) -> DataFrame:
    """One row per text: page_id, idx, panel_idx, near_idx, distance, as speakers() has them, without what only tails need."""
    return _over_pages(boxes, ["page_id", "idx", "panel_idx", "near_idx", "distance"])


def speakers(boxes: DataFrame, tails: DataFrame | None = None, limit: float = MAX_ANGLE) -> DataFrame:
    """One row per text: page_id, idx, panel_idx, type, tail_idx/angle (by tail), near_idx/distance, diagonal, character_idx, confidence.

    Figures compete only in the bubble's own panel; on a page without panels all figures and bubbles share a null panel. Without `tails` (page_id, idx, tail), boxes have a column `tail`.
    Boxes are read and dealt once; panels and nearest figures are found in `pages`, angles here over the figures of a text's own panel.
    """
    if tails is not None:
        boxes = boxes.drop("tail").join(tails.select("page_id", "idx", "tail", F.lit("text").alias("kind")), ["page_id", "idx", "kind"], "left")
    full = _over_pages(boxes, ["page_id", "idx", "panel_idx", *layout.BOX, "tail", "diagonal", "near_idx", "distance", "_figures"])
    full = full.withColumn("_tail", F.when(F.col("tail").isNotNull(), by_tail(F.col("_figures"), F.struct(*layout.BOX), F.col("tail"), limit)))
    tail_conf, near_conf = G.decay(F.col("_tail.angle"), G.num(limit)), G.decay(F.col("distance"), F.col("diagonal"))
    return full.select(
        "page_id", "idx", "panel_idx", *layout.BOX, bubble_type(F.col("tail")).alias("type"), "tail", "diagonal",
        F.col("_tail.idx").alias("tail_idx"), F.col("_tail.angle").alias("angle"), "near_idx", "distance",
        F.coalesce("_tail.idx", "near_idx").alias("character_idx"),
        F.when(F.col("_tail.idx").isNotNull(), tail_conf).when(F.col("near_idx").isNotNull(), near_conf).otherwise(G.num(0)).alias("confidence"),
    )


def bubbles_by_panel(panels: DataFrame, bubbles: DataFrame, fields: list[str]) -> DataFrame:
    """Panels with their bubbles as an array in order of idx; empty panels stay. Bubbles without a panel come with a null panel."""
    item = F.struct(F.col("idx").alias("i"), *fields)
    nested = bubbles.groupBy(F.col("page_id").alias("_bp"), F.col("panel_idx").alias("_bi")).agg(F.sort_array(F.collect_list(item)).alias("bubbles"))
    every = panels.select(F.col("page_id").alias("_pp"), F.col("idx").alias("_pi"))
    out = every.join(nested, (F.col("_pp") == F.col("_bp")) & F.col("_pi").eqNullSafe(F.col("_bi")), "full")
    none = F.array().cast(nested.schema["bubbles"].dataType)
    return out.select(F.coalesce("_pp", "_bp").alias("page_id"), F.coalesce("_pi", "_bi").alias("panel_idx"), F.coalesce("bubbles", none).alias("bubbles"))
