"""Command line: run, run-stage, resume, dump, doctor, inspect. Finished pages come from the cache, so running again resumes; dump prints reports.

python -m laminar.cli doctor --config pipeline.yaml
python -m laminar.cli inspect --path artifacts/page.json
python -m laminar.cli run-stage panel_detection --config pipeline.yaml --images pages --cache cache --table detections=detections.parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from laminar.plans import stages  # noqa: F401  registers the backends
from laminar.plans.pipeline import Cache, Pipeline, Settings
from laminar.sources import io


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="laminar")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run-stage")
    run.add_argument("stage")
    run.add_argument("--config", required=True)
    run.add_argument("--images", required=True)
    run.add_argument("--cache", required=True)
    run.add_argument("--table", action="append", default=[], help="name=path of an input table as Parquet")
    run.add_argument("--force", action="store_true")
    for command, what in (("run", "a range of stages"), ("resume", "a range of stages, finished pages from the cache"), ("dump", "a range of stages, its last as a report of every page")):
        span = sub.add_parser(command, help=what)
        span.add_argument("--from", dest="first")
        span.add_argument("--to", dest="last", default="character_embedding")
        for name in ("--config", "--images", "--cache"):
            span.add_argument(name, required=True)
        span.add_argument("--table", action="append", default=[])
        if command != "resume":
            span.add_argument("--force", action="store_true")
    doctor = sub.add_parser("doctor")
    doctor.add_argument("--config", required=True)
    inspect = sub.add_parser("inspect")
    inspect.add_argument("--path", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("laminar").getOrCreate()
    if a.command == "doctor":
        Settings.read(spark, a.config).doctor(spark).show(truncate=False)
    elif a.command == "inspect":
        for r in io.read_text(spark, a.path).toLocalIterator():
            print(r["value"])
    else:
        config = Settings.read(spark, a.config).checked()
        pages = io.page_images(spark, a.images, content=True)
        pipeline = Pipeline(config, Cache(spark, a.cache), inputs={k: spark.read.parquet(v) for k, v in (t.split("=", 1) for t in a.table)})
        first, last = (a.stage, a.stage) if a.command == "run-stage" else (a.first, a.last)
        out = pipeline.run(pages, first, last, getattr(a, "force", False))[last]
        report = {"vlm_extraction": io.panel_report, "character_embedding": io.character_report}.get(last, io.as_json) if a.command == "dump" else io.as_json
        for r in report(out).toLocalIterator():
            print(r[-1])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
