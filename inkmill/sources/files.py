"""Readers and writers of the file formats that corpora come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, hash): a row for each file, without byte-order mark, lines ended by newlines."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "\r\n", "\n")
    return raw.select("path", text.alias("text"), F.sha2("content", 256).alias("hash"))


def records(spark: SparkSession, glob: str) -> DataFrame:
    """JSON records with the file each came from."""
    return spark.read.option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))


def write_table(df: DataFrame, path: str) -> None:
    """One CSV file with a header; refuses to overwrite, and to write nothing."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def write_jsonl(df: DataFrame, path: str, *order: str, absent_only: bool = False) -> None:
    """Canonical JSON lines in the given order; commits whole or not at all."""
    from inkmill.functions.text import canonical_json

    names = sorted(df.columns)
    text = canonical_json(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    df.orderBy(*order).select(text.alias("value")).write.mode("ignore" if absent_only else "errorifexists").text(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of few rows as Markdown; refuses one of more than most rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if x is None else str(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n"


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One status or manifest record as canonical JSON; refuses to overwrite."""
    from inkmill.functions.text import canonical

    spark.createDataFrame([(canonical(record),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; if there is none that was written whole, what build gives is written there first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def aliased(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their present names: {old: present}; where a row has both, the old one's value counts if it isn't null."""
    for old, present in names.items():
        if old in df.columns:
            value = F.coalesce(old, present) if present in df.columns else F.col(old)
            df = df.withColumn(present, value).drop(old)
    return df
