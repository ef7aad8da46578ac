"""Scoring warehouse: paired gaps, summaries, checkpoint choice, feedback, criteria, ledger and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.text import criterion_key

FAILURES = 24


def _mean(x: Column) -> Column:
    return F.round(F.avg(x), 6)


def gaps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gap", F.round(F.col("human") - F.col("model"), 6))


def checkpoint_summary(rows: DataFrame) -> DataFrame:
    """Means are over graded rows (with a gap) only; counts of length_compliant over all."""
    graded = F.col("gap").isNotNull()
    return rows.groupBy("checkpoint", "split").agg(
        F.count("*").alias("examples"), F.count("gap").alias("paired_coverage"), (F.count("*") == F.count("gap")).alias("complete"),
        _mean(F.when(graded, F.col("human"))).alias("human"), _mean(F.when(graded, F.col("model"))).alias("model"), _mean(F.col("gap")).alias("gap"),
        F.round(F.try_divide(F.count_if(F.col("gap") > 0), F.count("gap")), 6).alias("positive_gap_fraction"), F.count_if(F.col("gap") == 0).alias("ties"), F.count_if("length_compliant").alias("length_compliant"),
    )


def kind_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("checkpoint", "split", "kind").agg(F.count("gap").alias("coverage"), _mean(F.col("gap")).alias("gap"))


def select_checkpoint(summary: DataFrame) -> DataFrame:
    """The earliest checkpoint of the highest training gap."""
    return summary.where("split = 'train' and gap is not null").agg(F.max(F.struct("gap", (-F.col("checkpoint")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("selected"), F.col("m.gap").alias("gap"))


def checkpoint_table(summary: DataFrame, selected: DataFrame) -> DataFrame:
    sides = [summary.where(F.col("split") == s).select("checkpoint", *[F.col(c).alias(f"{p}_{c}") for c in ("human", "model", "gap")], *([F.col("paired_coverage").alias("val_coverage")] if p == "val" else [])) for s, p in (("train", "train"), ("validation", "val"))]
    return sides[0].join(sides[1], "checkpoint").join(F.broadcast(selected.select("selected"))).withColumn("selected_by_train", F.col("checkpoint") == F.col("selected")).drop("selected")


def failures(rows: DataFrame, n: int = FAILURES) -> DataFrame:
    return rows.where("gap <= 0").orderBy("gap", "example_id").limit(n).select("example_id", "kind", "gap")


def carried(proposals: DataFrame) -> DataFrame:
    """The prompt in force after each iteration: the last accepted one."""
    w = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return proposals.withColumn("current", F.last(F.when(F.col("accepted"), F.col("prompt")), ignorenulls=True).over(w))


def gap_history(rows: DataFrame, checkpoints: list[int]) -> DataFrame:
    wide = rows.groupBy("example_id").pivot("checkpoint", checkpoints).agg(F.first("gap"))
    return wide.select("example_id", *[F.col(f"`{c}`").alias(f"gap_{c}") for c in checkpoints])


def criterion_heat(criteria: DataFrame, rubrics: DataFrame, top: int = 30) -> DataFrame:
    """(key, checkpoint, count, share): each key once per rubric; the top keys over all."""
    w = Window.partitionBy("rubric", "key").orderBy("pos")
    once = criteria.withColumn("key", criterion_key(F.col("id"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    per = once.groupBy("key", "checkpoint").agg(F.count("*").alias("count"))
    best = F.broadcast(once.groupBy("key").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "key").limit(top))
    n = rubrics.groupBy("checkpoint").agg(F.count("*").alias("rubrics"))
    return per.join(best, "key").join(n, "checkpoint").select("key", "checkpoint", "count", "total", F.round(F.try_divide("count", "rubrics"), 6).alias("share"))


def attempt_ledger(attempts: DataFrame) -> DataFrame:
    """(status, attempts, with_id, missing_id, retryable): sends by status; connect errors never have an id to miss."""
    lost = F.col("generation_id").isNull() & (F.col("status") != "connect_error")
    return attempts.groupBy("status").agg(F.count("*").alias("attempts"), F.count("generation_id").alias("with_id"), F.count_if(lost).alias("missing_id"), F.count_if(F.col("http_status").isin(408, 409, 425, 429, 500, 502, 503, 504)).alias("retryable"))


def cost_totals(attempts: DataFrame) -> DataFrame:
    """Exact sum over distinct generations, how many there are, and sends without one."""
    distinct = attempts.where("generation_id is not null").groupBy("generation_id").agg(F.max(F.col("cost").cast("decimal(18,6)")).alias("cost"))
    lost = F.count_if(F.col("generation_id").isNull() & (F.col("status") != "connect_error")).alias("unresolved")
    total = distinct.agg(F.count("*").alias("requests"), F.sum("cost").cast("double").alias("total_cost"))
    return total.join(attempts.agg(lost))


def retry_wait(attempt: Column, retry_after: Column, backoff=(2, 5, 15, 30, 60), most: int = 120) -> Column:
    told = F.when(retry_after.rlike(r"^\d+$"), F.least(retry_after.cast("int"), F.lit(most))).otherwise(F.lit(0))
    return F.greatest(F.get(F.array(*map(F.lit, backoff)), attempt), told)


def criterion_statistics(criteria: DataFrame) -> DataFrame:
    """(key, count, rubrics, human_scores, model_scores, human, model, variants, first_id) of criteria(rubric, id, pos, human_score, model_score): each key once a rubric, the first there; variants by count, then name."""
    w = Window.partitionBy("rubric", "key").orderBy("pos")
    once = criteria.withColumn("key", criterion_key(F.col("id"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    per_id = once.groupBy("key", "id").agg(F.count("*").alias("n"))
    variants = per_id.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id"))), lambda x: x["id"]).alias("variants"))
    stats = once.groupBy("key").agg(F.count("*").alias("count"), F.count("human_score").alias("human_scores"), F.count("model_score").alias("model_scores"), _mean(F.col("human_score")).alias("human"), _mean(F.col("model_score")).alias("model"), F.min_by("id", F.struct("rubric", "pos")).alias("first_id"))
    return stats.join(variants, "key")


def guarded(rows: DataFrame) -> DataFrame:
    """rows, if all are of the training split and have a gap; else the query that reads them fails."""
    wrong = F.when(F.col("split") != "train", F.lit("feedback needs training rows")).when(F.col("gap").isNull(), F.lit("a training grade is missing"))
    return rows.where(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.lit(True)))


def missing_generations(attempts: DataFrame) -> DataFrame:
    """The sends that cost something but have no generation id: all but connect errors."""
    return attempts.where(F.col("generation_id").isNull() & (F.col("status") != "connect_error")).select("path")
