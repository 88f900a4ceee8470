"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

toxicity            rows whose predicted label is toxic go
quality rules       rows that the base rules or the log-likelihood ratio reject go
near duplicates     one document of each SimHash component stays
decontamination     documents with passages of two benchmark items or more go; of one item, its words are cut out of the text
tokens              each text that is left, as byte-level BPE

All but the last return the columns of documents, and others that `docs` may have, whatever their names. Null and empty texts: not toxic, then rejected by the quality rules.
Repeated rows share their fate until the near duplicates, of which one stays; very long texts are handled whole; an empty table stays empty; without labels nothing is toxic and the base
rules alone decide; without benchmark items nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import bpe, common, decontamination, quality_rules, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, lexicon)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_rows(docs, common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Hash functions, learned weights and tokens are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    df = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, df = df, stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = common.written(df, f"pipeline-{i}")
            common.dropped(before)
    return df
