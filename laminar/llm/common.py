"""Helpers shared by the text operators: shared-folder tables and the fixed tokenisation rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.shipping import ship

#: Runs of white space between words; the complement of `[^\x20\x09-\x0D]+`.
SPACE_RE = r"[\x20\x09-\x0D]+"


#: Rows in an Arrow batch between the JVM and Python, unless the session says otherwise: texts are long, and Spark's 10,000 of them can fill a worker's memory.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session; only if that is unset, our own."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            top = os.path.join(tempfile.gettempdir(), "checkpoints")
        else:
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
    return top.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver's JVM ends, if it hasn't been dropped before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        path = t.__dict__.pop("_written_at", None)
        if path:
            hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def lean(run):
    """A function over Arrow batches that hands freed memory back to the system when its task ends: Python workers live on, and what several stages leave would add up."""

    def wrapped(batches):
        yield from run(batches)
        del batches
        release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library: it keeps what it keeps


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else; lower() is right, and faster, where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def split_words(text: Column, gap_re: str = SPACE_RE) -> Column:
    """The words between gaps, without the empty strings at the ends; null text has no words."""
    t = F.coalesce(text, F.lit(""))
    if gap_re == SPACE_RE:
        # plain replacements and a split at one character cost less than a split at a pattern
        for c in "\t\n\v\f\r":
            t = F.replace(t, F.lit(c), F.lit(" "))
        gap_re = " "
    return F.array_remove(F.split(t, gap_re), "")
