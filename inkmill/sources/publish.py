"""Atomic publication: a new version of a table is written beside the old one, and one rename makes it the current one.

A published path holds versions and a record of the current one: its folder, its number of rows, and a digest
of them that doesn't depend on their order. Readers resolve the record first, so a write that is stopped at any
point leaves them the version before, and a version that was changed since is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "CURRENT.json"


def content(df: DataFrame) -> dict:
    """The number of rows and a digest of them in any order; equal rows count as often as they are there."""
    row = F.sha2(F.to_json(F.struct(*[F.struct(F.lit(c).alias("n"), F.col(f"`{c}`").alias("v")) for c in sorted(df.columns)])), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    n, *sums = df.agg(F.count("*"), *parts).first()
    return {"rows": n, "digest": ":".join(f"{int(x or 0):x}" for x in sums)}


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_file(spark: SparkSession, path: str, value: str) -> None:
    """Makes path a file of this text, whole or not at all: a file beside it is renamed over it."""
    sc = spark.sparkContext
    staged, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(value.encode()))
    out.close()
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(staged, fs.makeQualified(sc._jvm.org.apache.hadoop.fs.Path(path)), how)


def current(spark: SparkSession, path: str) -> dict | None:
    """The record of the current version; None if there is none."""
    at, fs = _fs(spark, f"{path}/{CURRENT}")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/{CURRENT}", wholetext=True).first().value)


def publish(df: DataFrame, path: str) -> dict:
    """Writes df as a new version of the table at path and makes it current. The version before stays, for those that read it."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    record = {"version": version, "schema": df.schema.json()} | content(spark.read.parquet(f"{path}/{version}"))
    replace_file(spark, f"{path}/{CURRENT}", json.dumps(record, sort_keys=True))
    return record


def published(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The current version of the table at path. verify: reads it once and raises if it isn't what was published."""
    from pyspark.sql.types import StructType

    record = current(spark, path)
    if record is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    df = spark.read.schema(StructType.fromJson(json.loads(record["schema"]))).parquet(f"{path}/{record['version']}")
    if verify and (now := content(df)) != {k: record[k] for k in ("rows", "digest")}:
        raise ValueError(f"the version at {path} has changed: {now} is not what was published")
    return df


def forget(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the current one; how many."""
    at, fs = _fs(spark, path)
    record, n = current(spark, path), 0
    for s in fs.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("v-") and (record is None or name != record["version"]):
            n += fs.delete(s.getPath(), True)
    return n
