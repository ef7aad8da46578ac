"""The corpus pipeline: quality rules, near-dedup, repeated passages, benchmark leaks, the mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkmill.llm import decontam, mixing, near, quality, suffix
from inkmill.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", decontamination), ("mixing sources", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/inkmill-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs


#: Sketches, fingerprints and suffix arrays have no counterpart in SQL: tests/llm compares with brute force.
ORACLE_SQL = None
