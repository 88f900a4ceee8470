"""The four implemented stages over detection tables: model outputs are inputs, joined by page, and backends differ in how they use them.

inputs["detections"]: comic_id, page_id, kind (panel, text, tail, character), idx, x1, y1, x2, y2, score
inputs["tail_pairs"]: comic_id, page_id, ord, text_idx, tail_idx; inputs["readings"]: comic_id, page_id, idx, first, second, second_confidence;
inputs["answers"]: comic_id, page_id, panel_idx, raw; inputs["embeddings"]: comic_id, page_id, idx, v, hist, crop; inputs["names"]: character_id, name.
Any of them may come from a model run on executors (mapInPandas, an iterator pandas_udf) or from stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminar.functions import geometry as G
from laminar.functions import text as X
from laminar.functions import vectors as V
from laminar.operators import attribution, identity, layout, raster

from .pipeline import Stage

#: Least scores of a text with its tail, and of boxes by kind (fixed values).
PAIRED = 0.3
SCORES = {"panel": 0.2, "character": 0.3, "text": 0.3, "tail": 0.34}


def detected(detections: DataFrame, options: dict) -> DataFrame:
    """Detections above their kind's threshold as boxes; page_id is made unique over comics for the page-wise operators."""
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(options.get(f"{k}_detection_threshold", v)))) for k, v in SCORES.items()])
    kept = detections.where(F.coalesce("score", F.lit(1.0)) >= least)
    b = G.from_corners(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
    return kept.select("comic_id", F.col("page_id").alias("page"), F.struct("comic_id", "page_id").alias("page_id"), "kind", F.col("idx").cast("bigint").alias("idx"), *[b[k].alias(k) for k in layout.BOX])


def _page(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("page_id.comic_id").alias("comic_id"), F.col("page_id.page_id").alias("page_id"), *cols)


def _wire(*names: str):
    return F.array(*names)


def _panels_artifact(panels: DataFrame, paths: DataFrame, direction: str) -> DataFrame:
    order = layout.reading_order(panels, direction)
    rows = panels.join(order, ["page_id", "idx"])
    item = F.struct(
        "reading_order_index", X.numbered_id(F.col("page_id.page_id"), "p", F.col("idx")).alias("panel_id"), _wire(*layout.BOX).alias("bbox"), F.array().cast("array<array<double>>").alias("polygon")
    )
    nested = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("p"))
    out = _page(nested, F.transform("p", lambda r: F.struct(r["panel_id"], r["bbox"], r["polygon"], r["reading_order_index"])).alias("panels"))
    none = F.array().cast(out.schema["panels"].dataType)
    return paths.join(out, ["comic_id", "page_id"], "left").select("comic_id", "page_id", F.col("path").alias("image_path"), F.coalesce("panels", none).alias("panels"))


class DetectedPanels(Stage, of="panel_detection", backend="magi"):
    """Panels as detected, snapped to gutters where a raster (inputs["rasters"]) is there."""

    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        panels = detected(inputs["detections"], self.options).where("kind = 'panel'")
        if self.options.get("snap_to_gutters", True) and "rasters" in inputs:
            images = inputs["rasters"].select(F.struct("comic_id", "page_id").alias("page_id"), "height", "width", "gray")
            keep = panels.join(images.select("page_id"), "page_id", "left_anti").select("page_id", "idx", *layout.BOX)
            panels = raster.snap_boxes(images, panels.select("page_id", "idx", *layout.BOX), self.options.get("bg_brightness", 200), self.options.get("gutter_frac_threshold", 0.9), self.options.get("snap_min_gutter_px", 8), self.options.get("snap_max_search_fraction", 0.08)).unionByName(keep)
        return _panels_artifact(panels, inputs["_input"], self.options.get("reading_direction", "auto"))


class CutPanels(Stage, of="panel_detection", backend="cv_heuristic"):
    """Panels from gutters alone; inputs["rasters"]: comic_id, page_id, height, width, gray."""

    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        o = self.options
        images = inputs["rasters"].select(F.struct("comic_id", "page_id").alias("page_id"), "height", "width", "gray")
        boxes = raster.xy_cut(images, o.get("bg_brightness", 200), o.get("gutter_frac_threshold", 0.9), o.get("min_gutter_px", 5), o.get("min_panel_fraction", 0.06), o.get("max_bg_fraction_in_panel", 0.85))
        by_page = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "w", "h"))).alias("b"))
        numbered = by_page.select("page_id", F.posexplode("b").alias("idx", "b")).select("page_id", F.col("idx").cast("bigint").alias("idx"), "b.x", "b.y", "b.w", "b.h")
        return _panels_artifact(numbered, inputs["_input"], o.get("reading_direction", "auto"))


class DetectedBubbles(Stage, of="bubble_detection", backend="magi"):
    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        boxes = detected(inputs["detections"], self.options)
        met = inputs["tail_pairs"]
        if "score" in met.columns:
            met = met.where(F.coalesce("score", F.lit(1.0)) >= float(self.options.get("text_tail_matching_threshold", PAIRED)))
        pairs = met.select(F.struct("comic_id", "page_id").alias("page_id"), "ord", F.col("text_idx").cast("bigint").alias("text_idx"), F.col("tail_idx").cast("bigint").alias("tail_idx"))
        tails = attribution.tails_of(pairs, boxes.where("kind = 'tail'"))
        said = attribution.speakers(boxes.drop("page", "comic_id"), tails, float(self.options.get("attribution_max_angle_deg", 60.0)))
        figure = boxes.where("kind = 'character'").select("page_id", F.col("idx").alias("character_idx"), _wire(*layout.BOX).alias("attributed_character_bbox"))
        rows = said.join(figure, ["page_id", "character_idx"], "left").select(
            "page_id", "idx", "panel_idx", X.numbered_id(F.col("page_id.page_id"), "b", F.col("idx")).alias("bubble_id"), _wire(*layout.BOX).alias("bbox"), "type",
            F.when(F.col("tail").isNotNull(), F.array("tail.x", "tail.y")).alias("tail_point"), "attributed_character_bbox", F.col("confidence").alias("attribution_confidence"),
        )
        fields = ["bubble_id", "bbox", "type", "tail_point", "attributed_character_bbox", "attribution_confidence"]
        return nested_by_panel(boxes.where("kind = 'panel'"), rows, fields, "bubbles", inputs["_input"])


def nested_by_panel(panels: DataFrame, rows: DataFrame, fields: list[str], name: str, pages: DataFrame, extra: DataFrame | None = None, extra_fields: list[str] | None = None) -> DataFrame:
    """comic_id, page_id, panels: the page's panels by idx, each with its rows; rows without a panel come under a null panel_id."""
    by_panel = attribution.bubbles_by_panel(panels.select("page_id", "idx"), rows, fields)
    if extra is not None:
        by_panel = by_panel.join(extra, ["page_id", "panel_idx"], "left")
    item = F.struct(
        F.col("panel_idx").alias("_i"), F.when(F.col("panel_idx").isNotNull(), X.numbered_id(F.col("page_id.page_id"), "p", F.col("panel_idx"))).alias("panel_id"),
        *(extra_fields or []), F.transform("bubbles", lambda b: F.struct(*[b[f].alias(f) for f in fields])).alias(name),
    )
    nested = by_panel.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("p"))
    out = _page(nested, F.transform("p", lambda r: F.struct(r["panel_id"], *[r[f] for f in extra_fields or []], r[name])).alias("panels"))
    none = F.array().cast(out.schema["panels"].dataType)
    return pages.select("comic_id", "page_id").join(out, ["comic_id", "page_id"], "left").select("comic_id", "page_id", F.coalesce("panels", none).alias("panels"))


class ReadPanels(Stage, of="vlm_extraction", backend="qwen_vl_ollama"):
    """Readings chosen by letters, descriptions parsed from answers; answers that can't be used leave empty descriptions.

    Readings and text boxes of a page must match one to one, else the run fails with the page's name (option strict_readings: false lets it pass with empty texts).
    """

    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        boxes = detected(inputs["detections"], self.options)
        placed = layout.assign_to_panel(boxes.where("kind = 'text'"), boxes.where("kind = 'panel'"))
        key = F.struct("comic_id", "page_id").alias("page_id")
        read = inputs["readings"].select(key, F.col("idx").cast("bigint").alias("idx"), X.chosen_reading(F.col("first"), F.col("second"), F.col("second_confidence")).alias("r"))
        met = placed.join(read, ["page_id", "idx"], "left")
        if self.options.get("strict_readings", True):
            ours = read.join(inputs["_input"].select(F.struct("comic_id", "page_id").alias("page_id")), "page_id", "left_semi")
            met = placed.withColumn("_box", F.lit(True)).join(ours.withColumn("_read", F.lit(True)), ["page_id", "idx"], "full")
            said = F.concat(F.lit("readings and text boxes differ on page "), F.col("page_id.page_id"), F.lit(" at "), F.col("idx").cast("string"))
            met = met.withColumn("idx", F.when(F.col("_box").isNull() | F.col("_read").isNull(), F.raise_error(said).cast("bigint")).otherwise(F.col("idx")))
        rows = met.select(
            "page_id", "idx", "panel_idx", X.numbered_id(F.col("page_id.page_id"), "b", F.col("idx")).alias("bubble_id"), F.coalesce("r.text", F.lit("")).alias("dialogue_text"), F.coalesce("r.confidence", F.lit(0.0)).alias("ocr_confidence")
        )
        said = inputs["answers"].select(key, F.col("panel_idx").cast("bigint").alias("panel_idx"), X.answer(F.col("raw")).alias("a"))
        described = said.select("page_id", "panel_idx", *[F.coalesce(f"a.{f}", F.lit("")).alias(f) for f in X.REQUIRED], F.coalesce("a.onomatopoeia", F.array().cast("array<string>")).alias("onomatopoeia"))
        return nested_by_panel(boxes.where("kind = 'panel'"), rows, ["bubble_id", "dialogue_text", "ocr_confidence"], "bubbles", inputs["_input"], described, [*X.REQUIRED, "onomatopoeia"])


class Identities(Stage, of="character_embedding", backend=("clip", "dinov2")):
    """Figures' vectors, fused with colour, folded to identities page by page; every page lists the characters known so far."""

    whole_comics = True

    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        o = self.options
        boxes = detected(inputs["detections"], o)
        placed = layout.assign_to_panel(boxes.where("kind = 'character'"), boxes.where("kind = 'panel'")).where("panel_idx is not null")
        vec = inputs["embeddings"].select(F.struct("comic_id", "page_id").alias("page_id"), F.col("idx").cast("bigint").alias("idx"), V.fused(V.doubles(F.col("v")), F.coalesce("hist", F.array_repeat(F.lit(0.0), 16)), float(o.get("color_weight", 0.25))).alias("v"), "crop")
        rows = placed.join(vec, ["page_id", "idx"]).select("comic_id", "page", "idx", "panel_idx", "v", "crop")
        got = identity.assign(rows, ["comic_id"], ["page", "idx"], float(o.get("similarity_threshold", 0.55)), o.get("clustering_mode", "complete_linkage"))
        got = got.withColumn("character_id", X.character_id(F.col("cluster"))).join(rows.select("comic_id", "page", "idx", "panel_idx", "crop"), ["comic_id", "page", "idx"])
        given = F.struct("idx", X.numbered_id(F.col("page"), "p", F.col("panel_idx")).alias("panel_id"), F.lit(None).cast("string").alias("bubble_id"), "character_id", "similarity")
        assigned = got.groupBy("comic_id", "page").agg(F.sort_array(F.collect_list(given)).alias("a"))
        first = got.groupBy("comic_id", "cluster").agg(F.min_by("crop", F.struct("page", "idx")).alias("representative_crop"))
        known = identity.known_so_far(got, ["comic_id"], "page", ["idx"]).join(first, ["comic_id", "cluster"]).withColumn("character_id", X.character_id(F.col("cluster")))
        known = identity.named(known, inputs["names"]) if "names" in inputs else known.withColumn("name", F.lit(None).cast("string"))
        listed = known.groupBy("comic_id", "page").agg(F.sort_array(F.collect_list(F.struct("cluster", "character_id", "representative_crop", "name"))).alias("c"))
        out = assigned.join(listed, ["comic_id", "page"])
        return out.select(
            "comic_id", F.col("page").alias("page_id"), F.transform("c", lambda r: F.struct(r["character_id"], r["representative_crop"], r["name"])).alias("characters"),
            F.transform("a", lambda r: F.struct(r["panel_id"], r["bubble_id"], r["character_id"], r["similarity"])).alias("panel_assignments"),
        )

