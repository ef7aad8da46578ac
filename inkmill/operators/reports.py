"""What a viewer of runs shows: filtered and ordered sections, drafts, reasons, labels and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of a paper's sections.
KIND_ORDER = ("abstract", "introduction", "related_work", "conclusion")


def of_splits(df: DataFrame, *wanted: str, known: tuple[str, ...] = ("train", "validation", "confirmation")) -> DataFrame:
    """The rows of these splits; a split that there isn't is an error, not an empty result."""
    if unknown := set(wanted) - set(known):
        raise ValueError(f"unknown splits: {', '.join(sorted(unknown))}")
    return df.where(F.col("split").isin(*wanted))


def matching(sections: DataFrame, split: str = "all", kind: str = "all", find: str = "") -> DataFrame:
    """Sections of a split and kind whose id or title holds a text, in any case."""
    if split != "all":
        sections = sections.where(F.col("split") == split)
    if kind != "all":
        sections = sections.where(F.col("kind") == kind)
    return sections.where(F.contains(F.lower(F.concat_ws(" ", "example_id", "title")), F.lower(F.lit(find)))) if find else sections


def titled(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """rows(paper_id) with the first title (by pos) that papers(paper_id, title, pos) know, else the id."""
    first = papers.groupBy("paper_id").agg(F.min_by("title", "pos").alias("title"))
    return rows.join(first, "paper_id", "left").withColumn("title", F.coalesce("title", F.col("paper_id").cast("string")))


def section_list(sections: DataFrame, kinds: tuple[str, ...] = KIND_ORDER) -> DataFrame:
    """(split, paper_id, kinds): the sections of each paper in the order of kinds, unknown ones first; training first, then by name as readers sort it."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    per = sections.groupBy("split", "paper_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "kind"))).alias("s"))
    named = per.select("split", "paper_id", F.transform("s", lambda x: x["kind"]).alias("kinds"))
    return named.orderBy(F.col("split") != "train", F.collate(F.col("paper_id").cast("string"), "UNICODE"))


def earlier(attempts: Column) -> Column:
    """All attempts but the last."""
    return F.slice(attempts, F.lit(1), F.greatest(F.size(attempts) - 1, F.lit(0)))


def reasons(audits: Column) -> Column:
    """The reasons of all attempts in one list; an attempt without any adds none."""
    return F.flatten(F.transform(audits, lambda a: F.coalesce(a, F.array().cast("array<string>"))))


def signed(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull() | F.isnan(x), "–").when(x > 0, F.format_string(f"+%.{digits}f", x)).otherwise(F.format_string(f"%.{digits}f", x))


def label(checkpoint: Column, split: Column, example: Column) -> Column:
    """What paths and request identities call an example at a checkpoint."""
    return F.concat_ws("/", F.lit("main"), checkpoint.cast("string"), split, example.cast("string"))


def digits_path(book_id: Column) -> Column:
    """The folder of a book: the digits of its id but the last, one a level; 0 if there are no others."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.split(F.left(book_id, F.length(book_id) - 1), ""), lambda x: x != ""), "/"), F.lit("")), F.lit("0"))


def rubric_sizes(criteria: DataFrame) -> DataFrame:
    """(checkpoint, rubrics, criteria): the mean number of criteria of a rubric."""
    per = criteria.groupBy("checkpoint", "rubric").agg(F.count("*").alias("n"))
    return per.groupBy("checkpoint").agg(F.count("*").alias("rubrics"), F.round(F.avg("n"), 6).alias("criteria"))
