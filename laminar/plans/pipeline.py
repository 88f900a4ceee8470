"""The stage pipeline: configuration, registry of backends, execution of a range of stages, cached artifacts.

A stage turns tables into a table for all pages at once. Its cache is a manifest of (comic_id, page_id, stage, input_hash): pages whose hash is there are
read, only the others are computed (anti-join). The hash covers the page's content, the stage's configuration and the hash of the stage before, so a changed image or a changed
earlier stage is never served from the cache.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, ClassVar, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.functions import text as X
from laminar.schemas import STAGES
from laminar.sources import io

#: What `device` may be (fixed values).
DEVICES = ("auto", "cpu", "cuda", "mps")


class Stage:
    """A backend of a stage: inputs by stage name ("_input": comic_id, page_id, path, content) -> comic_id, page_id, artifact columns.

    A subclass names what it is in its header, `class X(Stage, of="tts", backend="espeak")` (several names as a tuple), and is found by that from then on.
    """

    known: ClassVar[dict[tuple[str, str], type[Stage]]] = {}

    def __init_subclass__(cls, of: str | None = None, backend: str | tuple[str, ...] = (), **rest: Any) -> None:
        super().__init_subclass__(**rest)
        names = (backend,) if isinstance(backend, str) else backend
        Stage.known.update({(of, n): cls for n in names if of})

    def __init__(self, options: dict[str, Any] | None = None) -> None:
        self.options = options or {}

    def transform(self, inputs: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError


def known_for(stage: str) -> list[str]:
    """Names of the backends that a stage has, sorted."""
    return sorted(n for s, n in Stage.known if s == stage)


class Choice(NamedTuple):
    """What a configuration says of one stage."""

    backend: str = ""
    device: str = "auto"
    options: dict[str, Any] = {}  # noqa: RUF012  never written


class Settings:
    """A configuration: the choices by stage, and everything that is wrong with it, found in one go when it is made."""

    def __init__(self, choices: dict[str, Choice] | None = None) -> None:
        self.choices = choices or {}
        self.problems = [p for stage, c in self.choices.items() for p in self._wrong(stage, c)]

    @staticmethod
    def _wrong(stage: str, c: Choice) -> list[str]:
        there = known_for(stage)
        tests = {
            f"{stage}: device {c.device!r} is none of {', '.join(DEVICES)}": c.device not in DEVICES,
            f"{stage}: no backend {c.backend!r}, only {', '.join(there)}": bool(there) and c.backend not in there,  # a stage that nobody has implemented may say anything
            f"{stage}: options are no mapping": not isinstance(c.options, dict),
        }
        return [text for text, wrong in tests.items() if wrong]

    @classmethod
    def parsed(cls, text: str) -> Settings:
        """From YAML; a text without `stages` has no choices. A key that no choice has is an error at once."""
        import yaml

        tree = yaml.safe_load(text) or {}
        return cls({stage: Choice(**entry) for stage, entry in (tree.get("stages") or {}).items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        return cls.parsed("\n".join(r["value"] for r in io.read_text(spark, path).collect()))

    def checked(self) -> Settings:
        if self.problems:
            raise ValueError("; ".join(self.problems))
        return self

    def of(self, stage: str) -> Choice:
        return self.choices.get(stage, Choice())

    def make(self, stage: str) -> Stage:
        """The stage's backend, with its options and, where its constructor asks for one, the device."""
        c = self.of(stage)
        cls = Stage.known.get((stage, c.backend))
        if cls is None:
            raise ValueError(f"{stage}: no backend {c.backend!r}, only {', '.join(known_for(stage))}")
        wants = inspect.signature(cls.__init__).parameters
        return cls(options=c.options, **({"device": resolved_device(c.device)} if "device" in wants else {}))

    def doctor(self, spark: SparkSession) -> DataFrame:
        """stage, backend, device, available."""
        rows = [(s, c.backend, resolved_device(c.device), (s, c.backend) in Stage.known) for s, c in self.choices.items()]
        return spark.createDataFrame(rows, "stage string, backend string, device string, available boolean")


def resolved_device(device: str, has: Callable[[str], bool] | None = None) -> str:
    """auto: the first of cuda, mps that is there, else cpu; anything else stays. Executors have the devices, so the driver's test is pluggable."""
    if device != "auto":
        return device
    return next((d for d in ("cuda", "mps") if has and has(d)), "cpu")


def chosen_range(first: str | None, last: str | None) -> list[str]:
    """Stage names from first to last, both included."""
    for s in (first, last):
        if s is not None and s not in STAGES:
            raise ValueError(f"unknown stage {s!r}; known: {STAGES}")
    return STAGES[STAGES.index(first) if first else 0 : (STAGES.index(last) if last else len(STAGES) - 1) + 1]


class Cache:
    """Artifacts as Parquet under root/stage, partitioned by comic and page, with their input hash."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, stage: str, schema) -> DataFrame | None:
        path = f"{self.root}/{stage}"
        return self.spark.read.schema(schema).parquet(path) if io._exists(self.spark, path) else None

    def write(self, stage: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("comic_id", "page_id").parquet(f"{self.root}/{stage}")


def hashes(pages: DataFrame, config: dict[str, Any], before: DataFrame | None) -> DataFrame:
    """comic_id, page_id, input_hash of pages(comic_id, page_id, content), the configuration and the hashes of the stage before."""
    rows = pages.select("comic_id", "page_id", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("_data"))
    if before is not None:
        rows = rows.join(before.select("comic_id", "page_id", F.col("input_hash").cast("binary").alias("_up")), ["comic_id", "page_id"], "left")
        rows = rows.withColumn("_data", F.concat("_data", F.coalesce("_up", F.lit(b""))))
    return rows.select("comic_id", "page_id", X.content_hash(F.col("_data"), config).alias("input_hash"))


def stale(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """The wanted (comic_id, page_id, input_hash) that the manifest lacks."""
    return wanted.join(manifest.select("comic_id", "page_id", "input_hash"), ["comic_id", "page_id", "input_hash"], "left_anti")


class Pipeline:
    def __init__(self, config: Settings, cache: Cache | None = None, stages: dict[str, Stage] | None = None, inputs: dict[str, DataFrame] | None = None) -> None:
        """inputs: tables of model outputs by name, as the stages read them."""
        self.config, self.cache, self.stages, self.inputs = config, cache, stages or {}, inputs or {}

    def stage(self, name: str) -> Stage:
        if name not in self.stages:
            self.stages[name] = self.config.make(name)
        return self.stages[name]

    def run(self, pages: DataFrame, first: str | None = None, last: str | None = None, force: bool = False) -> dict[str, DataFrame]:
        """Artifacts by stage for pages(comic_id, page_id, path, content); cached pages are read, the rest is computed and kept."""
        out = {"_input": pages, **self.inputs}
        before: DataFrame | None = None
        for name in chosen_range(first, last):
            stage, settings = self.stage(name), self.config.of(name)._asdict()
            keys = hashes(pages, settings, before)
            if self.cache is None:
                out[name] = stage.transform(out).join(keys, ["comic_id", "page_id"])
            else:
                full = stage.transform(out).join(keys, ["comic_id", "page_id"])
                old = None if force else self.cache.read(name, full.schema)
                todo = keys if old is None else stale(keys, old)
                if todo.limit(1).count():
                    whole = getattr(stage, "whole_comics", False)  # what depends on the pages before can't be computed for some pages only
                    keep = ["comic_id"] if whole else ["comic_id", "page_id"]
                    pages_todo = todo.select(*keep).distinct()
                    only = {k: v.join(pages_todo, keep, "left_semi") if set(keep) <= set(v.columns) else v for k, v in out.items()}
                    self.cache.write(name, stage.transform(only).join(keys if whole else todo, ["comic_id", "page_id"]))
                out[name] = self.cache.read(name, full.schema).join(keys, ["comic_id", "page_id", "input_hash"], "left_semi")
            before = out[name]
        return out
