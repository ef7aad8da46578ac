"""Intervals of a mean by a bootstrap that resamples whole sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.sampling import seeded
from inkmill.sources.stages import stage

#: Bits of a source's draw by which sources are counted before they are numbered.
COARSE = 12


def numbered(names: DataFrame, name: str, seed: int) -> DataFrame:
    """names with index, from 0, in the order of a draw for each name (null is one): counts by its first bits, then places within those."""
    drawn = names.select(name, seeded(seed, F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))).alias("_draw")).withColumn("_b", F.shiftright("_draw", 60 - COARSE))
    counts = drawn.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_draw", name)) - 1
    return drawn.join(F.broadcast(counts.select("_b", before.alias("_before"))), "_b").select(name, (F.col("_before") + place).cast("long").alias("index"))


def source_interval(rows: DataFrame, by: list[str], source: str, value: str, replicates: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by, sources, n, mean, low, high): the mean of value, and the percentile interval of its means over resampled sources.

    Each replicate draws as many sources as there are, with replacement, the same for all groups of by; a source counts
    as often as it is drawn, with all its rows of a group. Rows add up by source first, so that what travels are sources
    times replicates, not rows times replicates. Null values don't count; null is a source; a replicate whose sources have
    no value in a group has no mean there. Values are taken to six decimals, so that sums are exact.
    """
    per = rows.groupBy(*by, F.col(source).alias("_of")).agg(F.sum(F.col(value).cast("decimal(20,6)")).alias("_sum"), F.count(value).alias("_n"))
    names = stage(numbered(per.select("_of").distinct(), "_of", seed).select(F.col("_of").alias("_name"), F.col("index").alias("_at")), "sources")
    many = names.count()
    per = stage(per.join(names, F.col("_of").eqNullSafe(F.col("_name"))).select(*by, "_at", "_sum", "_n"), "sums")
    key = F.concat(F.col("_b").cast("string"), F.lit(":"), F.col("_at").cast("string"))
    picks = names.select("_at", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b")).select("_b", F.pmod(seeded(seed, key), F.lit(max(1, many))).alias("_at"))
    times = picks.groupBy("_b", "_at").agg(F.count("*").alias("_times"))
    means = per.join(times, "_at").groupBy(*by, "_b").agg(F.sum(F.col("_sum") * F.col("_times")).alias("_sum"), F.sum(F.col("_n") * F.col("_times")).alias("_n")).where("_n > 0").select(*by, _mean().alias("_m"))
    ends = means.groupBy(*by).agg(F.percentile("_m", [(1 - level) / 2, (1 + level) / 2]).alias("_e"))
    whole = per.groupBy(*by).agg(F.count_if(F.col("_n") > 0).alias("sources"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    joined = whole.join(ends, [whole[b].eqNullSafe(ends[b]) for b in by], "left") if by else whole.join(ends)
    return joined.select(*[whole[b] for b in by], "sources", F.col("_n").alias("n"), F.round(_mean(), 6).alias("mean"), F.round(F.get("_e", F.lit(0)), 6).alias("low"), F.round(F.get("_e", F.lit(1)), 6).alias("high"))


def _mean() -> Column:
    return F.when(F.col("_n") > 0, F.col("_sum").cast("double") / F.col("_n"))
