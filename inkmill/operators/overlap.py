"""Verbatim overlap: n-gram fractions, longest common runs, copied spans, leaked identifiers, red flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions.text import fold, ngrams, word_tokens, ws_words
from inkmill.sources.stages import stage

PROBE_NGRAM, MOST_FRACTION, LEAST_RUN, COPY_SPAN, IDENTIFIER = 13, 0.05, 20, 12, 5
#: The families of red flags, over folded text.
RED_FLAGS = {
    "origin_preference": r"(?:prefer|reward|favor|favour|boost)\s+(?:the\s+)?(?:human|expert|original)|(?:penaliz|penalis|punish|downscore)\w*\s+(?:the\s+)?(?:model|ai|generated)",
    "origin_detection": r"(?:detect|guess|infer|identify|determine)\s+(?:the\s+)?(?:authorship|origin|provenance)|(?:human.written|ai.generated|model.generated)\s+(?:tells|markers|signals)",
    "wrapper_override": r"(?:ignore|override|replace)\s+(?:the\s+)?(?:wrapper|system|grading|schema)|(?:weighted\s+(?:mean|average)|unequal\s+weight|score\s+(?:from\s+)?0\s*(?:to|[-–])\s*100)",
    "leaked_markup": r"<tool_call|<function=|</function|<\|im_|\{\s*$",
}
#: Rows of the smaller side up to which it is broadcast.
MOST_BROADCAST = 500_000
#: Identifiers that tasks are told at a time.
MOST_IDENTIFIERS = 100_000


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def grams_of(df: DataFrame, key: str, n: int) -> DataFrame:
    tokens = df.select(key, word_tokens(F.col("text")).alias("t"))
    return tokens.select(key, F.explode_outer(ngrams("t", n)).alias("g")).where("g is not null")


def _near(outputs: DataFrame, told: DataFrame, words: Callable[[Column], Column], n: int) -> DataFrame:
    """The rows of outputs(doc_id, text) that may share an n-gram with told(text), and all that do.

    Of any n-gram, one of the pieces of half its words lies at a place that the stride meets, so outputs make a piece for
    each stride, not an n-gram for each word; all pieces of told are known.
    """
    half = (n + 1) // 2
    stride = n - half + 1
    known = _hint(told.select(words(F.col("text")).alias("t")).select(F.explode(ngrams("t", half)).alias("g")).distinct())
    t = outputs.select("doc_id", words(F.col("text")).alias("t")).where(F.size("t") >= n)
    starts = F.sequence(F.lit(1), F.size("t") - (half - 1), F.lit(stride))
    pieces = t.select("doc_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("t", i, F.lit(half)), " "))).alias("g"))
    near = stage(pieces.join(known, "g", "left_semi").select(F.col("doc_id").alias("near")).distinct(), "near")
    return outputs.join(_hint(near), F.col("doc_id").eqNullSafe(F.col("near")), "left_semi")


def ngram_overlap(outputs: DataFrame, references: DataFrame, n: int = PROBE_NGRAM) -> DataFrame:
    """(doc_id, item_id, hits, n, ngram_fraction): the share of a reference's distinct n-grams that an output has, for pairs that share one."""
    ref = grams_of(references, "item_id", n).distinct()
    sizes = ref.groupBy("item_id").agg(F.count("*").alias("n"))
    near = _near(outputs.select("doc_id", "text"), references, word_tokens, n)
    found = grams_of(near, "doc_id", n).join(_hint(ref), "g").distinct()
    hits = found.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    return hits.join(sizes, "item_id").select("doc_id", "item_id", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("ngram_fraction"))


def longest_runs(pairs: DataFrame, outputs: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_run): the longest run of words common to each pair, as the longest island on a diagonal of equal words."""
    a = outputs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode_outer(word_tokens(F.col("text"))).alias("i", "w"))
    b = references.select("item_id", F.posexplode_outer(word_tokens(F.col("text"))).alias("j", "w"))
    cells = pairs.select("doc_id", "item_id").join(b, "item_id").join(a, ["doc_id", "w"]).select("doc_id", "item_id", "i", (F.col("i") - F.col("j")).alias("d"))
    w = Window.partitionBy("doc_id", "item_id", "d").orderBy("i")
    islands = cells.withColumn("k", F.col("i") - F.row_number().over(w)).groupBy("doc_id", "item_id", "d", "k").agg(F.count("*").alias("run"))
    return islands.groupBy("doc_id", "item_id").agg(F.max("run").alias("longest_run"))


def probed(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs with a shared n-gram, their run and whether they count as memorized. A run of LEAST_RUN words implies a shared n-gram, so no pair is missed."""
    pairs = stage(ngram_overlap(outputs, references), "pairs")  # read three times
    return pairs.join(longest_runs(pairs, outputs, references), ["doc_id", "item_id"]).withColumn("memorized", (F.col("ngram_fraction") > MOST_FRACTION) | (F.col("longest_run") >= LEAST_RUN))


def unmemorized(outputs: DataFrame, references: DataFrame) -> DataFrame:
    return outputs.join(probed(outputs, references).where("memorized").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


def _span_words(x: Column) -> Column:
    return ws_words(fold(x))


def spans_of(df: DataFrame, key: str, pos: str, n: int = COPY_SPAN) -> DataFrame:
    """n-grams of folded white-space words, punctuation kept."""
    tokens = df.select(key, _span_words(F.col("text")).alias("t"))
    return tokens.select(key, F.posexplode_outer(ngrams("t", n)).alias(pos, "g")).where("g is not null")


def copied_spans(proposals: DataFrame, sources: DataFrame, allowed: str = "") -> DataFrame:
    """(doc_id, item_id, first_pos, span): the first span of a proposal that a source has and the allowed text has not."""
    src = _hint(spans_of(sources, "item_id", "j").select("item_id", "g").distinct())
    near = _near(proposals.select("doc_id", "text"), sources, _span_words, COPY_SPAN)
    found = spans_of(near, "doc_id", "i").join(src, "g").where(~F.contains(F.lit(allowed), F.col("g")))
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("i", "g")).alias("m")).select("doc_id", "item_id", F.col("m.i").cast("long").alias("first_pos"), F.col("m.g").alias("span"))


def _identified(told):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ahocorasick.Automaton()
        for x in told.value:
            known.add_word(x, x)
        known.make_automaton()
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                mine = sorted({x for _, x in known.iter(t or "")})
                at += [i] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "identifier"])

    return f


def identifier_leaks(proposals: DataFrame, identifiers: DataFrame, least: int = IDENTIFIER) -> DataFrame:
    """(doc_id, identifier) where a folded identifier of enough characters is part of the folded text.

    Texts are read once for each block of identifiers, by an automaton of all of them, so the work is that of
    reading and not of texts times identifiers; null texts have none.
    """
    spark = proposals.sparkSession
    ids = stage(identifiers.select(fold(F.col("identifier")).alias("identifier")).where(F.length("identifier") >= least).distinct(), "identifiers")
    blocks = -(-ids.count() // MOST_IDENTIFIERS)
    kind = proposals.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"doc_id {kind}, identifier string")
    texts = proposals.select("doc_id", fold(F.col("text")).alias("text"))
    for k in range(blocks):
        own = ids.where(F.pmod(F.xxhash64("identifier"), F.lit(blocks)) == k).collect()
        told = spark.sparkContext.broadcast([r.identifier for r in own])
        found = found.union(texts.mapInArrow(_identified(told), f"doc_id {kind}, identifier string"))
    return found


def red_flags(text: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(fold(text).rlike(p), F.lit(k)) for k, p in RED_FLAGS.items()])))


def audited(proposals: DataFrame, sources: DataFrame, identifiers: DataFrame, most_words: int, allowed: str = "") -> DataFrame:
    """(doc_id, words, reasons, accepted) of proposals(doc_id, text): too many words, red flags, and what they leak of the sources: spans and identifiers."""
    leaks = copied_spans(proposals, sources, allowed).select("doc_id").unionByName(identifier_leaks(proposals, identifiers).select("doc_id")).distinct().withColumn("leaks", F.lit(True))
    words = F.size(ws_words(F.col("text"))).cast("long")
    long = F.when(words > most_words, F.lit("meta_prompt_word_bound"))
    rows = proposals.join(leaks, "doc_id", "left").select("doc_id", words.alias("words"), F.array_sort(F.array_compact(F.concat(F.array(long, F.when(F.col("leaks"), F.lit("training_leakage"))), red_flags(F.col("text"))))).alias("reasons"))
    return rows.withColumn("accepted", F.size("reasons") == 0)
