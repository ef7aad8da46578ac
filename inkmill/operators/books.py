"""Book extraction and selection: paragraph types, prefix sums, cuts, passages, lesser-read works, quotas."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkmill.functions.text import NOT_BLANK, normalize_line, normalize_paragraphs, ws_words

HEADING_WORDS, PROSE_WORDS, LOOKAHEAD, SCENE = 12, 40, 3, 3
CONTINUATION, CONTEXT_WORDS, CUTS, BOOKS_PER_AUTHOR, SEED = (300, 800), 2000, 6, 3, 20261005
#: The marks of a book's start and end, of notes in it, of headings and of breaks.
START = r"(?im)^\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG E(?:BOOK|TEXT).*$"
END = r"(?im)^\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG E(?:BOOK|TEXT).*$"
BRACKETED = r"(?is)\[(?:Illustration|Footnote|Sidenote|Transcriber|Note)\b[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"
FOOTNOTE_MARK = r"\[(?:\d+|[A-Z])\]"
ITALICS = r"(?sU)(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"
DASH = r"-{2,}"
PRODUCTION_NOTE = r"(?i)^(?:produced by|e-?text prepared by|transcriber'?s? notes?|this e-?book was produced|updated editions|end of (?:the )?project gutenberg)"
HEADING = r"(?i)^(?:(?:chapter|book|part|volume|epilogue|prologue|interlude)\b.{0,80}|[IVXLC]+\.?|\d+\.?|[IVXLC]+\.\s.{0,80}|the end\.?)$"
SCENE_BREAK = r"^[\s*·.•\-—_=#~+]+$"
STORY_HEADING = r"(?i)^(?:chapter|book|part)\s+(?:i|1|one|first)\b|^(?:i|1)\.?(?:\s|$)"


def paragraph_type(p: Column, indented: Column | None = None) -> Column:
    """break, heading, block or prose."""
    capitals = (p == F.upper(p)) & (p != F.lower(p)) & ~p.startswith('"')
    kind = F.when(p.rlike(SCENE_BREAK), F.lit("break")).when((F.size(ws_words(p)) <= HEADING_WORDS) & (p.rlike(HEADING) | capitals), F.lit("heading"))
    return (kind.when(indented, F.lit("block")) if indented is not None else kind).otherwise(F.lit("prose"))


def book_body(raw: Column) -> Column:
    """The text between a book's marks, without notes in brackets, with plain italics and long dashes; null if a mark is missing."""
    text = F.replace(F.regexp_replace(raw, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))
    # a lambda's variable is worked out once, so a text is split once at each mark
    ended = F.transform(F.slice(F.split(text, START, 2), 2, 1), lambda x: F.split(x, END, 2))
    body = F.get(F.flatten(F.filter(ended, lambda x: F.size(x) > 1)), F.lit(0))
    body = F.regexp_replace(F.regexp_replace(body, BRACKETED, ""), FOOTNOTE_MARK, "")
    # a look behind at every character is dear: only texts with an underscore pay for it
    plain = F.transform(F.array(body), lambda x: F.when(F.contains(x, F.lit("_")), F.regexp_replace(x, ITALICS, "$1")).otherwise(x))
    return F.regexp_replace(F.get(plain, F.lit(0)), DASH, "—")


def book_paragraphs(books: DataFrame) -> DataFrame:
    """(doc_id, pos, type, words, text) of books(doc_id, raw): stretches between blank lines, each on one line, from the first story heading that has prose close behind. Books without marks or such a heading have no rows."""
    chunks = books.select("doc_id", F.posexplode_outer(F.split(book_body(F.col("raw")), r"\n[ \t]*\n")).alias("at", "chunk")).where("chunk is not null")
    lines = F.filter(F.split("chunk", "\n"), lambda x: x.rlike(NOT_BLANK))
    rows = chunks.withColumn("lines", lines).where(F.size("lines") > 0)
    rows = rows.select("doc_id", "at", F.forall("lines", lambda x: x.rlike(r"^\s{2,}\S")).alias("indented"), normalize_line(F.array_join("lines", " ")).alias("text"))
    rows = rows.where(~F.col("text").rlike(PRODUCTION_NOTE))
    rows = rows.select("doc_id", "at", paragraph_type(F.col("text"), F.col("indented")).alias("type"), F.size(ws_words(F.col("text"))).cast("long").alias("words"), "text")
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("long")).drop("at")
    # the start by a window, as a join would read and clean all books twice
    rows = rows.withColumn("first", F.min(F.when(_opens(Window.partitionBy("doc_id").orderBy("pos")), F.col("pos"))).over(Window.partitionBy("doc_id")))
    rows = rows.where(F.col("pos") >= F.col("first"))
    return rows.select("doc_id", (F.col("pos") - F.col("first")).alias("pos"), "type", "words", "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, type, words, text): the non-blank lines of each text."""
    lines = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "text"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), paragraph_type(F.col("text")).alias("type"), F.size(ws_words(F.col("text"))).cast("long").alias("words"), "text")


def prefix_words(paras: DataFrame) -> DataFrame:
    """paras with before: the words of earlier paragraphs; scene: whether the SCENE before are all prose; stop: the next paragraph that isn't."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    prose = (F.col("type") == "prose").cast("int")
    before = F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scene = (F.col("pos") >= SCENE) & (F.min(prose).over(w.rowsBetween(-SCENE, -1)) == 1)
    stop = F.min(F.when(F.col("type") != "prose", F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return paras.select("*", before.alias("before"), F.coalesce(scene, F.lit(False)).alias("scene"), stop.alias("stop"))


def cut_candidates(paras: DataFrame, target: int = CONTINUATION[0], most: int = CONTINUATION[1], context: int = CONTEXT_WORDS) -> DataFrame:
    """(doc_id, start, end, target_words): from each start after a scene and after `context` words, paragraphs up to the first that reaches target words, all prose, most words at most.

    Words before a paragraph rise with its place, so the first end in reach is the first row of a range of them.
    """
    p = prefix_words(paras).withColumn("upto", F.col("before") + F.col("words"))
    nothing = F.lit(None).cast("long")
    marks = p.select("doc_id", "upto", F.col("pos").alias("last"), nothing.alias("start"), nothing.alias("before"), nothing.alias("stop"))
    asks = p.where(F.col("scene") & (F.col("type") == "prose") & (F.col("before") >= context)).select("doc_id", (F.col("before") + target).alias("upto"), nothing.alias("last"), F.col("pos").alias("start"), "before", "stop")
    # downwards, so that the least end so far is kept from row to row
    reach = Window.partitionBy("doc_id").orderBy(F.desc("upto")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asks).withColumn("end_at", F.min(F.when(F.col("last").isNotNull(), F.struct("upto", "last"))).over(reach))
    found = found.where("start is not null").select("doc_id", "start", F.col("end_at.last").alias("last"), (F.col("end_at.upto") - F.col("before")).alias("target_words"), "stop")
    return found.where((F.col("target_words") <= most) & (F.col("stop").isNull() | (F.col("last") < F.col("stop")))).select("doc_id", "start", (F.col("last") + 1).alias("end"), "target_words")


def cut_sample(paras: DataFrame, n: int = CUTS, words: tuple[int, int] = CONTINUATION, context: int = CONTEXT_WORDS) -> DataFrame:
    """(doc_id, start, end): n cuts of each book at most, drawn by a generator seeded with the book's id.

    Each start after a scene and after `context` words draws a length, in order; it counts if prose paragraphs
    reach that length within words[1]. Then each of n equal stretches of the words after context draws one of
    its starts, none inside the cut before. One task reads a book's paragraphs without their texts, of books alone that
    have a start: the others, most of a corpus of short texts, would cost a call each and draw nothing.
    """
    starts = F.col("scene") & (F.col("before") >= context)
    p = prefix_words(paras).withColumn("starts", F.max(starts).over(Window.partitionBy("doc_id"))).where("starts").select("doc_id", "pos", "before", "words", "scene", "type", "stop")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = pdf.sort_values("pos"), random.Random(f"{SEED}:{pdf.doc_id.iloc[0]}")
        upto, before, kept = (pdf.before + pdf.words).to_numpy(), pdf.before.to_numpy(), []
        for k in np.flatnonzero(pdf.scene.to_numpy() & (before >= context)).tolist():
            wanted = rng.randint(*words)
            last = int(np.searchsorted(upto, before[k] + wanted))
            stop = pdf.stop.iloc[k]
            if last < (len(pdf) if pd.isna(stop) else int(stop)) and words[0] <= upto[last] - before[k] <= words[1]:
                kept.append((k, last + 1))
        whole, free, out = int(upto[-1]) - context, 0, []
        for part in range(n):
            low, high = (context + whole * x / n for x in (part, part + 1))
            fits = [c for c in kept if low <= before[c[0]] < high and c[0] >= free]
            if fits:
                out.append(rng.choice(fits))
                free = out[-1][1]
        return pd.DataFrame([(int(pdf.doc_id.iloc[0]), *c) for c in out], columns=["doc_id", "start", "end"])

    return p.groupBy("doc_id").applyInPandas(draw, "doc_id long, start long, end long")


def _opens(book: WindowSpec) -> Column:
    """Whether a paragraph is a heading of a story's opening with long prose close behind."""
    long_prose = ((F.col("type") == "prose") & (F.col("words") >= PROSE_WORDS)).cast("int")
    return (F.col("type") == "heading") & F.col("text").rlike(STORY_HEADING) & (F.max(long_prose).over(book.rowsBetween(1, LOOKAHEAD)) == 1)


def story_start(paras: DataFrame) -> DataFrame:
    """(doc_id, start): the first heading of a story's opening with long prose close behind."""
    return paras.withColumn("opens", _opens(Window.partitionBy("doc_id").orderBy("pos"))).where("opens").groupBy("doc_id").agg(F.min("pos").alias("start"))


def passages(cuts: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, start, context_hash, reference_hash): texts before a cut and in it, normalized, a blank line between paragraphs."""
    texts = paras.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("t"))
    both = cuts.join(texts, "doc_id")
    context = F.array_join(F.slice("t", F.lit(1), F.col("start").cast("int")), "\n")
    reference = F.array_join(F.slice("t", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "\n")
    return both.select("doc_id", "start", F.sha2(normalize_paragraphs(context), 256).alias("context_hash"), F.sha2(normalize_paragraphs(reference), 256).alias("reference_hash"))


def lesser_read(books: DataFrame) -> DataFrame:
    """Of books(author, stem, book_id, downloads): the most read of each stem; of those, the ones read less than the author's upper median."""
    w = Window.partitionBy("author", "stem").orderBy(F.desc("downloads"), "pos")
    unique = books.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    by = Window.partitionBy("author")
    placed = unique.withColumns({"k": F.row_number().over(by.orderBy("downloads")) - 1, "n": F.count("*").over(by)})
    middle = placed.where("k = n div 2").select("author", F.col("downloads").alias("median"))
    return unique.join(middle, "author").where("downloads < median").select("author", "book_id", "downloads", "median")


def round_robin(books: DataFrame, n: int) -> DataFrame:
    """The first n books of each split, authors in turn in the order of their first book."""
    by_author = Window.partitionBy("split", "author").orderBy("pos")
    first = Window.partitionBy("split", "author")
    ranked = books.withColumn("rank", F.row_number().over(by_author)).withColumn("first_pos", F.min("pos").over(first))
    return ranked.withColumn("turn", F.row_number().over(Window.partitionBy("split").orderBy("rank", "first_pos"))).where(F.col("turn") <= n).select("split", "turn", "author", "book_id")


def with_records(novels: DataFrame, records: DataFrame) -> DataFrame:
    """novels(book_id) with their downloads and rights; 0 and '' for those without a record."""
    both = novels.join(records.select("book_id", "downloads", "rights"), "book_id", "left")
    return both.withColumns({"downloads": F.coalesce("downloads", F.lit(0)), "rights": F.coalesce("rights", F.lit(""))})


def first_cuts(cuts: DataFrame, n: int = 4) -> DataFrame:
    """The first n cuts of each book, numbered."""
    w = Window.partitionBy("doc_id").orderBy("start")
    return cuts.withColumn("index", F.row_number().over(w) - 1).where(F.col("index") < n)


def quota_walk(books: DataFrame, needs: dict[str, int], per_author: int = 3, seed: int = SEED, most: int = 100_000) -> DataFrame:
    """(book_id, author, split): authors in a seeded order go whole to the first split that needs books, each with per_author at most.

    books(author, author_pos, book_id, pos, fit): what fit says is worked out before, so that the walk, in one task,
    reads a catalog's ids only; more than most of them, or too few that fit, is an error. The generator orders authors, then
    each one's books as it comes to them.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"a catalog of {len(pdf)} books; {most} at most")
        rng, left, out = random.Random(seed), dict(needs), []
        catalog = {a: list(zip(g.book_id, g.fit)) for a, g in pdf.sort_values(["author_pos", "pos"]).groupby("author", sort=False)}
        authors = list(catalog)
        rng.shuffle(authors)
        for author in authors:
            open_ = [s for s, n in left.items() if n > 0]
            if not open_:
                break
            rng.shuffle(catalog[author])
            fit = [b for b, ok in catalog[author] if ok][: min(per_author, left[open_[0]])]
            left[open_[0]] -= len(fit)
            out += [(b, author, open_[0]) for b in fit]
        if any(n > 0 for n in left.values()):
            raise ValueError(f"not enough books that fit; still needed: {left}")
        return pd.DataFrame(out, columns=["book_id", "author", "split"])

    return books.select("author", "author_pos", "book_id", "pos", "fit", F.lit(0).alias("whole")).groupBy("whole").applyInPandas(walk, "book_id string, author string, split string")
