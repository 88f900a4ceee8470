"""Seams for models: Python callables run on executors and give the tables that the stages read.

A callable comes with `load`, which makes the model once in each worker and is remembered by its key; rows come in Arrow batches.
Nothing here knows a model: tests inject small functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our instructions for a model that describes a panel, and for one that compares two figures.
DESCRIBE = "Look at this panel. Answer with one JSON object with the keys action_description, setting, mood (texts) and onomatopoeia (a list of sound words you can see, empty if there are none). Leave speech out."
COMPARE = "Do these two crops show the same person? Look at face, hair, build and clothes, not at pose or colour of light. Answer with one JSON object with the keys same_character (true or false) and reason."

_LOADED: dict[tuple, Any] = {}


def loaded(key: tuple, load: Callable[[], Any]) -> Any:
    """The model of this key, made once in a worker process."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


DETECTIONS = "comic_id string, page_id string, kind string, idx int, x1 double, y1 double, x2 double, y2 double, score double"


def detect(pages: DataFrame, load: Callable[[], Any], fn: Callable[[Any, bytes], dict[str, list[tuple]]], key: tuple = ("detect",)) -> DataFrame:
    """pages(comic_id, page_id, content) -> detections; fn(model, bytes) gives lists of (x1, y1, x2, y2, score) by kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(key, load)
        for pdf in batches:
            rows = [(r.comic_id, r.page_id, kind, i, *map(float, d)) for r in pdf.itertuples() for kind, found in fn(model, bytes(r.content)).items() for i, d in enumerate(found)]
            yield pd.DataFrame(rows, columns=["comic_id", "page_id", "kind", "idx", "x1", "y1", "x2", "y2", "score"])

    return pages.select("comic_id", "page_id", "content").mapInPandas(run, DETECTIONS)


def mapped(rows: DataFrame, inputs: list[str], out: str, kind: str, load: Callable[[], Any], fn: Callable[..., Any], key: tuple) -> DataFrame:
    """rows with `out` = fn(model, *inputs): embeddings (array<double>), readings (struct), descriptions (string)."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = loaded(key, load)
        for cols in batches:
            yield pd.Series([fn(model, *vals) for vals in zip(*cols, strict=True)])

    # pandas_udf reads the annotations; the single-column form takes a plain iterator of series
    if len(inputs) == 1:

        def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(key, load)
            for col in batches:
                yield pd.Series([fn(model, v) for v in col])

        single.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return rows.withColumn(out, F.pandas_udf(single, kind)(*inputs))
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, kind)(*inputs))


def verdicts(load: Callable[[], Any], fn: Callable[[Any, str, str], bool], key: tuple = ("verdict",)) -> Callable[[DataFrame], DataFrame]:
    """A verdict for refine(): same = fn(model, crop_a, crop_b), asked once for each gated pair."""
    return lambda pairs: mapped(pairs, ["crop_a", "crop_b"], "same", "boolean", load, fn, key)


def stored_verdicts(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A verdict from a table (crop_a, crop_b, same); pairs that nobody judged are different."""
    return lambda pairs: pairs.join(known.select("crop_a", "crop_b", "same"), ["crop_a", "crop_b"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


def panel_counts(artifacts: DataFrame) -> DataFrame:
    """page_id, panels, bubbles of artifacts whose panels hold bubbles."""
    total = F.aggregate(F.transform("panels", lambda p: F.size(p["bubbles"])), F.lit(0), lambda a, n: a + n)
    return artifacts.select("page_id", F.size("panels").alias("panels"), total.alias("bubbles"))


def page_counts(artifacts: DataFrame) -> DataFrame:
    """page_id and, for every list column of an artifact, how many it holds on the page."""
    lists = [f.name for f in artifacts.schema.fields if f.dataType.typeName() == "array"]
    return artifacts.select("page_id", *[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in lists])
