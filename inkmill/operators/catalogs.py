"""Which rows of a book catalog are novels to choose from, by fixed rules, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import fold

#: What a catalog row must say, words that rule its subjects out, titles of volumes and collections, rights, and the least length.
KIND, LANGUAGE, ILLUSTRATOR, SUBJECT = "Text", "en", "[Illustrator]", "fiction"
OTHER_SUBJECTS = ("short stories", "drama", "poetry", "juvenile")
COLLECTION = r"(?i)\bvol(?:ume|\.)?\s*(?:\d|[ivx]+\b)|\b(?:stories|tales|essays|sketches)\b"
RIGHTS, LEAST_WORDS = "Public domain in the USA.", 30_000
#: Authors, or excluded books, up to which they are broadcast.
MOST_BROADCAST = 200_000


def title_line(title: Column) -> Column:
    """A title on one line, without white space around it."""
    return F.trim(F.regexp_replace(title, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def names(authors: Column) -> Column:
    return F.filter(F.transform(F.split(authors, ";"), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x != "")


def _told(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def catalog(rows: DataFrame, authors: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, title, author, subjects, reason) for each of rows(book_id, type, title, language, authors, subjects).

    reason is null for the novels of authors(name) that are not excluded(book_id); else the first rule that rules
    the row out. author is the principal author, where there is one alone; null fields are empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = rows.select("book_id", "type", title_line(text("title")).alias("title"), "language", names(text("authors")).alias("_all"), text("subjects").alias("subjects"))
    df = df.withColumn("_first", F.filter("_all", lambda n: ~F.contains(n, F.lit("["))))
    df = df.withColumn("author", F.when(F.size("_first") == 1, F.get("_first", F.lit(0))))
    known = authors.select(F.col("name").alias("author")).distinct().withColumn("_known", F.lit(True))
    out = excluded.select("book_id").distinct().withColumn("_out", F.lit(True))
    df = df.join(_told(known), "author", "left").join(_told(out), "book_id", "left")
    subject = fold(F.col("subjects"))
    others = F.exists("_all", lambda n: F.contains(n, F.lit("[")) & ~F.endswith(n, F.lit(ILLUSTRATOR)))
    ruled_out = F.rlike(subject, F.lit("|".join(OTHER_SUBJECTS)))
    is_not = lambda c, x: ~F.coalesce(F.col(c) == x, F.lit(False))
    reason = (
        F.when(is_not("type", KIND), "not a text")
        .when(is_not("language", LANGUAGE), "not in English")
        .when(F.col("_out"), "excluded")
        .when(F.col("author").isNull(), "not one principal author")
        .when(F.col("_known").isNull(), "not an author of the list")
        .when(others, "names others than illustrators")
        .when(~F.contains(subject, F.lit(SUBJECT)), "not fiction")
        .when(ruled_out, "another kind of fiction")
        .when(F.rlike("title", F.lit(COLLECTION)), "a volume or a collection")
    )
    return df.select("book_id", "title", "author", "subjects", reason.alias("reason"))


def eligible(books: DataFrame) -> DataFrame:
    """books(rights, story_words, ...) with reason: null where the rights are RIGHTS and the story has LEAST_WORDS words or more."""
    words = F.coalesce("story_words", F.lit(0)).cast("long")
    short = F.concat(F.lit("Story has "), words.cast("string"), F.lit(f" words; at least {LEAST_WORDS} required"))
    rights = F.coalesce(F.col("rights") == RIGHTS, F.lit(False))
    return books.withColumn("reason", F.when(~rights, F.concat(F.lit("Rights: "), F.coalesce("rights", F.lit("")))).when(words < LEAST_WORDS, short))
