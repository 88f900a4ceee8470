"""Readers and writers. Everything goes through Spark's readers and writers, so that any store they know will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar import schemas
from laminar.functions import text as X

#: Image suffixes, the preferred one first (fixed values).
SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]


def page_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """comic_id, page_id, path (and content) under root/comic/page.suffix: of several files of a page the preferred suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(root)
    parts = F.regexp_extract("path", r"([^/]+)/([^/]+)(\.[^./]+)$", 1), F.regexp_extract("path", r"([^/]+)(\.[^./]+)$", 1), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    rows = files.select(parts[0].alias("comic_id"), parts[1].alias("page_id"), parts[2].alias("suffix"), "path", *(["content"] if content else []))
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    keep = F.min_by(F.struct("path", *(["content"] if content else [])), rank)
    return rows.groupBy("comic_id", "page_id").agg(keep.alias("f")).select("comic_id", "page_id", "f.*")


def missing_pages(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """The wanted (comic_id, page_id) without an image."""
    return wanted.join(images, ["comic_id", "page_id"], "left_anti")


def crops(spark: SparkSession, folder: str) -> DataFrame:
    """character_id, path of crop files named character__page_cNNN.png, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*__*.png").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+?)__[^/]*\.png$", 1).alias("character_id"), "path").orderBy("path")


def read_artifacts(spark: SparkSession, path: str | list[str], stage: str, strict: bool = True) -> DataFrame:
    """JSON artifacts of a stage, one a file, in the stage's schema; strict readers fail on text that doesn't fit."""
    return spark.read.schema(schemas.ARTIFACTS[stage]).option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: each file's text as it is."""
    return spark.read.text(path, wholetext=True)


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(schemas.LOG).option("multiLine", "true").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """comic_id, backend, character_id, pos, v, crop: members of the stored clusters; empty if nothing was stored."""
    kind = "character_id string, pos bigint, v array<double>, crop string, comic_id string, backend string"
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(path)


def write_store(members: DataFrame, path: str) -> None:
    """Replaces the partitions (comic_id, backend) that `members` holds; others stay."""
    members.select("character_id", "pos", "v", "crop", "comic_id", "backend").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("comic_id", "backend").parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """character_id, name from a YAML map; empty if the file is absent or empty."""
    kind = "character_id string, name string"
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    import yaml

    raw = yaml.safe_load("\n".join(r["value"] for r in read_text(spark, path).collect())) or {}  # one small file
    return spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in raw.items()], kind)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_hashed_artifacts(df: DataFrame, root: str, stage: str) -> None:
    """One JSON text for each (comic_id, page_id, input_hash) of a stage's table, in a folder named by the three and the stage; what is there for other hashes stays."""
    keys = ["comic_id", "page_id", "input_hash"]
    body = F.to_json(F.struct(*[c for c in df.columns if c not in keys]), {"ignoreNullFields": "false", "pretty": "true"})
    rows = df.select("comic_id", "page_id", F.lit(stage).alias("stage"), "input_hash", body.alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("comic_id", "page_id", "stage", "input_hash").text(root)


def read_hashed_artifacts(spark: SparkSession, root: str, stage: str, schema) -> DataFrame:
    """comic_id, page_id, input_hash and the fields of the artifacts that write_hashed_artifacts() left; folders of other stages are not read."""
    rows = spark.read.schema("value string, comic_id string, page_id string, stage string, input_hash string").text(root, wholetext=True).where(F.col("stage") == stage)
    return rows.select("comic_id", "page_id", "input_hash", F.from_json("value", schema).alias("a")).select("comic_id", "page_id", "input_hash", "a.*")


def write_log(log: DataFrame, path: str) -> None:
    """A verification log, a line an entry, in one file: a log has an entry for each question put to the model."""
    write_json(log.coalesce(1), path)


def panel_report(extractions: DataFrame) -> DataFrame:
    """page_id, report: a page's panels, their descriptions and lines as text, in the artifact's order."""
    quoted = lambda s: F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    lines = lambda p: F.concat(
        F.array(
            F.format_string("=== %s ===", p["panel_id"]), F.format_string("  action:   %s", p["action_description"]), F.format_string("  setting:  %s", p["setting"]), F.format_string("  mood:     %s", p["mood"]),
            F.concat(F.lit("  sfx:      ["), F.array_join(F.transform(p["onomatopoeia"], quoted), ", "), F.lit("]")),
        ),
        F.transform(p["bubbles"], lambda b: F.concat(F.format_string("    [%.2f] ", b["ocr_confidence"]), quoted(b["dialogue_text"]))), F.array(F.lit("")),
    )
    return extractions.select("page_id", F.array_join(F.flatten(F.transform("panels", lines)), "\n").alias("report"))


def character_report(index: DataFrame) -> DataFrame:
    """report: known characters and a page's assignments as text; index(page_id, characters, panel_assignments)."""
    head = F.array(F.format_string("=== known characters so far: %d ===", F.size("characters")))
    named = F.transform("characters", lambda c: F.format_string("  %s  name=%s", c["character_id"], F.coalesce(F.concat(F.lit("'"), c["name"], F.lit("'")), F.lit("None"))))
    given = F.transform("panel_assignments", lambda a: F.format_string("  %s: %s (similarity=%.2f)", a["panel_id"], a["character_id"], a["similarity"]))
    title = F.array(F.lit(""), F.format_string("=== %s assignments ===", "page_id"))
    return index.select("page_id", F.array_join(F.concat(head, named, title, given), "\n").alias("report"))


def crop_name(character_id, page_id, i):
    """character__page_c007.png"""
    return F.format_string("%s__%s_c%03d.png", character_id, page_id, i)


def hashed(files: DataFrame, config: dict | None = None) -> DataFrame:
    """files(path, content) -> path, input_hash of the bytes and the configuration."""
    return files.select("path", X.content_hash(F.col("content"), config).alias("input_hash"))
