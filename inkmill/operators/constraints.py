"""Integrity constraints as queries that return the rows that violate them: no rows, no violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import ws_words


def in_several(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that lie in more than one group."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("groups")).where("groups > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def not_equal_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def hash_mismatch(df: DataFrame, text: str, hashed: str) -> DataFrame:
    return df.where(~F.sha2(text, 256).eqNullSafe(F.col(hashed)))


def word_mismatch(df: DataFrame, text: str, words: str) -> DataFrame:
    return df.where((F.col(words) <= 0) | (F.size(ws_words(F.col(text))) != F.col(words)))


def reference_visible(df: DataFrame) -> DataFrame:
    return df.where(F.contains("context", F.col("reference")))


def positional_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Positions at which two numbered lists differ, or that only one has."""
    left, right = a.select("pos", F.col(key).alias("left_key")), b.select("pos", F.col(key).alias("right_key"))
    return left.join(right, "pos", "full_outer").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def bad_scores(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 10))


def fields_differ(rows: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where a row of the same key has another value than expected, or where only one side has the key (field 'missing')."""
    a = rows.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields], F.lit(True).alias("has_a"))
    b = expected.select(F.col(key).alias("b_key"), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields], F.lit(True).alias("has_b"))
    both = a.join(b, F.col(key) == F.col("b_key"), "full_outer")
    missing = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), F.lit("missing"))
    differ = [F.when(missing.isNull() & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]
    return both.select(F.coalesce(key, "b_key").alias(key), F.explode(F.array_compact(F.array(missing, *differ))).alias("field"))


def counts_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right): one row if the tables differ in their number of rows."""
    return a.agg(F.count("*").alias("left")).join(b.agg(F.count("*").alias("right"))).where(F.col("left") != F.col("right"))


def kinds_incomplete(df: DataFrame, group: str, kind: str, needed: list[str]) -> DataFrame:
    """(group, repeated, missing): groups that have a kind twice, or lack one that is needed."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.collect_set(kind).alias("kinds"))
    missing = F.array_except(F.array(*map(F.lit, needed)), F.col("kinds"))
    return per.select(group, (F.col("n") > F.size("kinds")).alias("repeated"), F.array_sort(missing).alias("missing")).where(F.col("repeated") | (F.size("missing") > 0))


def keys_differ(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """(group, only_left, only_right): groups whose sets of keys differ, or of which only one side has rows."""
    side = lambda df, n: df.groupBy(F.col(group).alias(f"{n}_group")).agg(F.collect_set(key).alias(n))
    both = side(a, "l").join(side(b, "r"), F.col("l_group") == F.col("r_group"), "full_outer")
    none = F.array().cast("array<string>")
    l, r = F.coalesce(F.col("l").cast("array<string>"), none), F.coalesce(F.col("r").cast("array<string>"), none)
    out = both.select(F.coalesce("l_group", "r_group").alias(group), F.array_sort(F.array_except(l, r)).alias("only_left"), F.array_sort(F.array_except(r, l)).alias("only_right"))
    return out.where((F.size("only_left") > 0) | (F.size("only_right") > 0))


def table_digest(df: DataFrame, *names: str) -> DataFrame:
    """(rows, digest): a digest of the rows, whatever their order: SHA-256 over the sums of the parts of each row's own."""
    h = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(" ", *parts), 256).alias("digest"))


def listed_otherwise(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, split_differs, provenance_differs): rows whose split or provenance (any struct) differs from the one listed under the key; both for one that isn't listed."""
    told = listed.select(key, F.col("split").alias("l_split"), F.to_json("provenance", {"ignoreNullFields": "false"}).alias("l_provenance"))
    both = rows.join(told, key, "left")
    split, provenance = ~F.col("split").eqNullSafe(F.col("l_split")), ~F.to_json("provenance", {"ignoreNullFields": "false"}).eqNullSafe(F.col("l_provenance"))
    return both.select(key, split.alias("split_differs"), provenance.alias("provenance_differs")).where(F.col("split_differs") | F.col("provenance_differs"))
