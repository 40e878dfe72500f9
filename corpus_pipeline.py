"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and
reads it back as the next stage's documents. Rejected documents go; of each group of near copies one stays;
documents that hold a benchmark item go; credentials are replaced in the texts unless they are placeholders or
widely copied; the texts that are left are packed into sequences of 1024 tokens.

Defined cases: null, empty and blank texts fail the quality rules; very long texts are worked on whole; of repeated
rows with an id one stays, and rows without an id stay unless another row has the same text; extra columns, whatever
their names, go through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from sparkloom.sources.shared import delete, materialize, temporary_tables
from sparkloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_live(docs, shared_by=secret_scan.WIDELY_SHARED_BY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), capacity=1024)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminated", decontaminated), ("secrets", secrets), ("packed", packed)]

#: The stages learn a model and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass; of the tables written on the way only the last result's are left."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with temporary_tables(spark) as paths:
            docs = materialize(stage(spark, docs, sf_dir))
            kept.append(paths.pop())  # the table just written; the stage's own ones go
        for path in kept[:-1]:
            delete(spark, path)
        kept = kept[-1:]
    return docs
