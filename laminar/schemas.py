"""Schemas of the nine stages' artifacts and of the stores, and a check that gives violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the artifact format.
BUBBLE_TYPES = ["speech", "thought", "narration", "sfx"]
EMOTIONS = ["neutral", "anger", "fear", "sadness", "joy", "surprise", "disgust", "whisper", "shout"]
LINE_TYPES = ["dialogue", "narration", "thought"]
STAGES = ["panel_detection", "bubble_detection", "vlm_extraction", "character_embedding", "script_generation", "tts", "animation", "music_sfx", "compositing"]


#: DDL by stage; readers take it as it is, artifact() makes it a StructType (which needs a session).
ARTIFACTS: dict[str, str] = {
    "panel_detection": "page_id string, image_path string, panels array<struct<panel_id:string,bbox:array<double>,polygon:array<array<double>>,reading_order_index:int>>",
    "bubble_detection": "page_id string, panels array<struct<panel_id:string,bubbles:array<struct<bubble_id:string,bbox:array<double>,type:string,tail_point:array<double>,attributed_character_bbox:array<double>,attribution_confidence:double>>>>",
    "vlm_extraction": "page_id string, panels array<struct<panel_id:string,action_description:string,setting:string,mood:string,onomatopoeia:array<string>,bubbles:array<struct<bubble_id:string,dialogue_text:string,ocr_confidence:double>>>>",
    "character_embedding": "characters array<struct<character_id:string,representative_crop:string,name:string>>, panel_assignments array<struct<panel_id:string,bubble_id:string,character_id:string,similarity:double>>",
    "script_generation": "page_id string, script_lines array<struct<panel_id:string,bubble_id:string,character_id:string,type:string,text:string,emotion:string,intensity:int>>",
    "tts": "page_id string, lines array<struct<panel_id:string,bubble_id:string,character_id:string,audio_path:string,duration_sec:double>>",
    "animation": "page_id string, clips array<struct<panel_id:string,clip_path:string,duration_sec:double,motion_prompt:string>>",
    "music_sfx": "music_tracks array<struct<scene_id:string,pages:array<string>,path:string>>, sfx array<struct<panel_id:string,onomatopoeia:string,path:string>>",
    "compositing": "comic_id string, entries array<struct<panel_id:string,start_sec:double,end_sec:double,clip_path:string,dialogue_audio_paths:array<string>,music_path:string,sfx_paths:array<string>>>, output_path string",
}

STORE = "clusters array<struct<character_id:string,members:array<array<double>>,count:int,representative_crop:string,crop_paths:array<string>>>"
LOG = "type string, character_id string, a string, b string, `from` string, `to` string, `into` string, sim double, same boolean, sizes array<int>"


def artifact(stage: str) -> T.StructType:
    return T.StructType.fromDDL(ARTIFACTS[stage])


def _each(array: str, test) -> Column:
    return F.exists(F.col(array), lambda x: F.coalesce(test(x), F.lit(True)))


def _rules(stage: str) -> list[tuple[str, Column]]:
    """(what is wrong, when) of a stage; nulls where a value is required count as wrong."""
    no = lambda x: x.isNull()
    four = lambda b: F.size(b) != 4
    if stage == "panel_detection":
        ranks = F.sort_array(F.transform("panels", lambda p: p["reading_order_index"]))
        return [
            ("page_id is missing", no(F.col("page_id"))), ("a panel has no id", _each("panels", lambda p: no(p["panel_id"]))), ("a box has not four numbers", _each("panels", lambda p: four(p["bbox"]))),
            ("reading order is no permutation", (F.size("panels") > 0) & (ranks != F.when(F.size("panels") > 0, F.sequence(F.lit(0), F.size("panels") - 1)))),
        ]
    if stage == "bubble_detection":
        flat = F.flatten(F.transform("panels", lambda p: p["bubbles"]))
        return [
            ("page_id is missing", no(F.col("page_id"))),
            ("unknown bubble type", F.exists(flat, lambda b: F.coalesce(~b["type"].isin(BUBBLE_TYPES), F.lit(True)))),
            ("a box has not four numbers", F.exists(flat, lambda b: F.coalesce(four(b["bbox"]), F.lit(True)))),
            ("confidence out of 0 to 1", F.exists(flat, lambda b: F.coalesce(~b["attribution_confidence"].between(0.0, 1.0), F.lit(True)))),
        ]
    if stage == "vlm_extraction":
        return [("page_id is missing", no(F.col("page_id"))), ("a panel lacks a description", _each("panels", lambda p: no(p["action_description"]) | no(p["setting"]) | no(p["mood"])))]
    if stage == "character_embedding":
        known = F.transform("characters", lambda c: c["character_id"])
        return [("an assignment names an unknown character", F.exists("panel_assignments", lambda a: ~F.array_contains(known, F.coalesce(a["character_id"], F.lit("")))))]
    if stage == "script_generation":
        return [
            ("unknown line type", _each("script_lines", lambda x: ~x["type"].isin(LINE_TYPES))), ("unknown emotion", _each("script_lines", lambda x: ~x["emotion"].isin(EMOTIONS))),
            ("intensity out of 1 to 5", _each("script_lines", lambda x: ~x["intensity"].between(1, 5))),
        ]
    if stage == "tts":
        return [("a line has no audio or duration", _each("lines", lambda x: no(x["audio_path"]) | no(x["duration_sec"])))]
    if stage == "animation":
        return [("a clip has no path or duration", _each("clips", lambda x: no(x["clip_path"]) | no(x["duration_sec"])))]
    if stage == "music_sfx":
        return [("a track has no path", _each("music_tracks", lambda x: no(x["path"]))), ("a cue has no path", _each("sfx", lambda x: no(x["path"])))]
    if stage == "compositing":
        return [("an entry has no span", _each("entries", lambda x: no(x["start_sec"]) | no(x["end_sec"]))), ("output_path is missing", no(F.col("output_path")))]
    raise ValueError(f"unknown stage {stage!r}; known: {STAGES}")


def violations(stage: str, artifacts: DataFrame) -> DataFrame:
    """artifacts in the stage's schema -> a row for each broken rule: the artifact's columns and `violation`."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(what)) for what, bad in _rules(stage)]))
    return artifacts.select("*", F.explode(found).alias("violation"))
