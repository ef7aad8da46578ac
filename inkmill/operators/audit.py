"""Audit of a completed run: where two versions of a table differ, by trees of hashes over ranges of keys.

A version is written in ranges of its keys' hashes, beside a tree: a leaf tells how many rows a range has and
a digest of them in any order, a node that of FANOUT below it. Two trees are compared from the top, only
below nodes that differ, and rows are read of the ranges alone that differ at the end. Of those, which may be all
once changes are many, digests of rows are compared, and whole rows alone that have no like digest on the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from inkmill.sources.stages import removed, stage

FANOUT, RANGES = 16, 256
#: Digests that differ up to which they are broadcast.
MOST_BROADCAST = 500_000
#: JSON of a value tells microseconds, whatever the session's time zone.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def _levels(ranges: int) -> int:
    n, levels = ranges, 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _row(fields: list[StructField]) -> Column:
    """A digest of a row: names and values, nulls told apart, each told by its length."""
    said = []
    for f in sorted(fields, key=lambda f: f.name):
        v = F.col(f"`{f.name}`")
        x = v.cast("string") if isinstance(f.dataType, StringType) else F.to_json(F.struct(v.alias("v")), EXACT)
        said += [F.lit(f"{len(f.name)}:{f.name}"), F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))]
    return F.unhex(F.sha2(F.concat(*said), 256))


def write_version(df: DataFrame, path: str, key: str, ranges: int = RANGES) -> None:
    """df in ranges of its key's hash at path/rows, and their tree(level, node, n, digest) at path/tree; refuses to overwrite."""
    spark = df.sparkSession
    for name in ("_range", "_digest"):
        if name in df.columns:
            raise ValueError(f"a column is named {name}")
    ranged = df.withColumn("_range", F.pmod(F.xxhash64(F.col(f"`{key}`").isNull(), f"`{key}`"), F.lit(ranges)).cast("int"))
    ranged.repartition("_range").withColumn("_digest", _row(df.schema.fields)).write.partitionBy("_range").parquet(f"{path}/rows")
    digests = spark.read.schema(StructType([StructField("_digest", BinaryType()), StructField("_range", IntegerType())])).parquet(f"{path}/rows")
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    level = digests.select("_range", F.hex("_digest").alias("h")).groupBy(F.col("_range").alias("node")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *parts), 256).alias("digest"))
    level.withColumn("level", F.lit(0)).write.parquet(f"{path}/tree/0")
    for k in range(_levels(ranges)):
        below = spark.read.parquet(f"{path}/tree/{k}")
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws("=", x["node"].cast("string"), x["digest"]))
        level = below.groupBy(F.expr(f"node div {FANOUT}").cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, ","), 256).alias("digest"))
        level.withColumn("level", F.lit(k + 1)).write.parquet(f"{path}/tree/{k + 1}")


def differing(spark: SparkSession, old: str, new: str, ranges: int = RANGES) -> tuple[list[int], int]:
    """The ranges in which two versions differ, RANGES of them at most, and how many nodes of either tree were compared."""
    above, compared = None, 0
    for k in range(_levels(ranges), -1, -1):
        sides = [spark.read.parquet(f"{p}/tree/{k}") for p in (old, new)]
        if above is not None:
            sides = [x.where(F.expr(f"node div {FANOUT}").isin(above)) for x in sides]
        a, b = (x.select("node", F.struct("n", "digest").alias(name)) for x, name in zip(sides, "ab", strict=True))
        both = a.join(b, "node", "full_outer").select("node", F.col("a").eqNullSafe(F.col("b")).alias("same")).collect()
        compared += len(both)
        above = sorted(r.node for r in both if not r.same)
        if not above:
            return [], compared
    return above, compared


def changes(spark: SparkSession, old: str, new: str, ranges: int = RANGES) -> DataFrame:
    """The rows of a version with side: old for those that only the old one has, new for those of the new one alone; copies count.

    Both were written with the same columns, key and ranges. Only ranges that differ are read, and rows with a digest that
    either version has more often are the only ones to be dealt out whole; where they are many, the join that finds them deals out all rows of those ranges.
    """
    where, _ = differing(spark, old, new, ranges)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col("_range").isin(where)).drop("_range") for p in (old, new))
    if a.dtypes != b.dtypes:
        raise ValueError("the versions have other columns")
    each = a.select("_digest", F.lit(1).alias("n")).unionByName(b.select("_digest", F.lit(-1).alias("n")))
    apart = stage(each.groupBy("_digest").agg(F.sum("n").alias("n")).where("n != 0").select(F.xxhash64("_digest").alias("_apart")), "audit-digests")
    few = F.broadcast(apart) if apart.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else apart
    # rows whose hash is that of a digest apart by chance, and rows alike of other digests (0.0 and -0.0), are on both sides and cancel out
    a, b = (stage(x.join(few, F.xxhash64(x["_digest"]) == few["_apart"], "left_semi").drop("_digest"), "audit-rows") for x in (a, b))
    removed(apart)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
