"""The attempts ledger as a stream (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attempts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def distinct_generations(stream: DataFrame, time: str = "ts", key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each generation once, as long as repeats come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "event_type").agg(F.count("*").alias("n"))
