"""Quality rules with adaptive thresholds, DataFrame functions only.

Per document: word, symbol, repeated-line and repeated-window counts. Four rates are counts out of lengths,
both with half a count more for either outcome: a text without a symbol has the rate that one of its length
can't tell from zero, so a group's quantile says something even where most of its documents have none. The
rates of the documents that pass the base rules go into quantile sketches, one per (language, source): counts of values in buckets whose
bounds grow by GAMMA, so a quantile is known within that factor, whatever the order of the rows. Sketches
add up: those of sources to their language's, those of languages to the corpus's. A fence is STRETCH times
the group's quantile at the rate's LEVEL, drawn towards the language's, and that to the corpus's, by SHRINK
documents' weight, so that small groups lean on larger ones without a step. No fence has a fixed part.
A document goes if a rate is over its fence by more than chance: its count less two standard errors is.

The counts are written once as a narrow table; texts are read once and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import ROW, SPACE, SPACE_CHARS, carried, only, row_key, small_enough, table, written

WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Per rate: what is counted, out of what, and the quantile, in thousandths, that the fence stands on. Symbols are rare in prose, so their level leaves room for much junk.
RATES = {"symbol_rate": ("n_symbols", "word_chars", 800), "dup_line_rate": ("n_dup_lines", "n_lines", 990), "repeat_rate": ("n_repeat_words", "n_words", 990), "upper_rate": ("n_upper", "word_chars", 990)}
STRETCH, SHRINK, ERRORS, GAMMA = 1.5, 100, 2.0, 1.02
#: Groups up to which their fences are broadcast.
MOST_BROADCAST = 100_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def counted(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and the counts of each row's whole text. Null and empty texts count zero everywhere."""
    t = F.col("t")
    df = docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce("text", F.lit("")).alias("t"))
    df = df.select(
        *keys,
        words_of(t).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
    )
    # a window is known by the 64-bit hash of its words; two of one text would have to collide to be mistaken
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    df = df.select(
        *keys,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    # most texts repeat no window: their hashes are all distinct, and they stop here
    df = df.withColumn("some", F.size(F.array_distinct("g")) < F.size("g"))
    df = df.withColumn("z", F.when(F.col("some"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.transform("z", lambda x, i: F.when((F.get("z", i - 1)["h"] == x["h"]) | (F.get("z", i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(*[p + k for k in range(WINDOW)])))))
    df = df.withColumn("n_repeat_words", F.when(F.col("some"), covered).otherwise(0).cast("long"))
    return df.select(*keys, *COUNTS, "n_upper", "n_lines")


def _rate(part: str, whole: str) -> Column:
    return (F.col(part) + 0.5) / (F.col(whole) + 1)


def rated(counts: DataFrame) -> DataFrame:
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.withColumns({k: _rate(a, b) for k, (a, b, _) in RATES.items()}).withColumn("base_failed", base)


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the documents that pass the base rules, by bucket of each rate. Some thousand rows a group at most."""
    bucket = lambda r: F.ceil(F.log(r) / F.log(F.lit(GAMMA))).cast("int")
    each = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(r).alias("bucket")) for r in RATES])
    return rates.where(~F.col("base_failed")).select("lang", "source", F.inline(each)).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def quantiles(bins: DataFrame, *keys: str) -> DataFrame:
    """(keys, rate, docs, q): q is the upper bound of the bucket in which the rate's LEVEL lies."""
    merged = bins.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rate")
    ends = merged.withColumns({"docs": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bucket"))})
    level = reduce(lambda c, r: c.when(F.col("rate") == r, RATES[r][2]), list(RATES)[1:], F.when(F.col("rate") == list(RATES)[0], RATES[list(RATES)[0]][2]))
    at = ends.where(1000 * F.col("upto") >= level * F.col("docs")).groupBy(*keys, "rate", "docs").agg(F.min("bucket").alias("bucket"))
    return at.select(*keys, "rate", "docs", F.pow(F.lit(GAMMA), F.col("bucket")).alias("q"))


def fences(rates: DataFrame) -> DataFrame:
    """(lang, source, a fence for each rate): a row for each group that has a document. Groups none of whose documents passes have their language's, then the corpus's."""
    bins = written(sketches(rates), "sketches")
    own = quantiles(bins, "lang", "source").withColumnsRenamed({"lang": "o_lang", "source": "o_source", "rate": "o_rate", "docs": "o_docs", "q": "o_q"})
    lang = quantiles(bins, "lang").withColumnsRenamed({"lang": "l_lang", "rate": "l_rate", "docs": "l_docs", "q": "l_q"})
    corpus = quantiles(bins).select(F.col("rate").alias("a_rate"), F.col("q").alias("a_q"))
    groups = rates.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, RATES))).alias("rate"))
    out = groups.join(own, F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")) & (F.col("rate") == F.col("o_rate")), "left")
    # a row for each rate
    out = out.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")), "left").join(F.broadcast(corpus), F.col("rate") == F.col("a_rate"), "left")
    zero = F.lit(0)
    drawn = lambda n, q, to: (F.coalesce(n * q, F.lit(0.0)) + SHRINK * to) / (F.coalesce(n, zero) + SHRINK)
    of_lang = drawn(F.col("l_docs"), F.col("l_q"), F.coalesce("a_q", F.lit(0.0)))
    fence = F.lit(STRETCH) * drawn(F.col("o_docs"), F.col("o_q"), of_lang)
    return out.withColumn("fence", fence).groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"{r}_fence") for r in RATES])


def judged(docs: DataFrame, *keys: str) -> DataFrame:
    """For each row of docs(doc_id, text, lang, source): keys, its counts, rates and fences, base_failed, kept.

    Null or empty text: no words, so base_failed. Null languages and sources are groups of their own.
    Repeated rows, and rows that share an id or have none, are judged one by one. Of equal rates all or none
    are over a fence. An empty table gives an empty result.
    """
    counts = written(rated(counted(only(docs, *keys, "doc_id", "text", "lang", "source"), *keys, "doc_id", "lang", "source")), "counts")
    limits = written(fences(counts).withColumnsRenamed({"lang": "f_lang", "source": "f_source"}), "fences")
    if small_enough(limits, MOST_BROADCAST):
        limits = F.broadcast(limits)  # else a source with a third of the rows would be one task
    both = counts.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    verdict = ~F.col("base_failed")
    for r, (part, whole, _) in RATES.items():
        sure = F.col(part) - ERRORS * F.sqrt(F.col(part).cast("double"))
        verdict = verdict & (sure <= F.col(f"{r}_fence") * F.col(whole) + F.lit(1e-9))
    return both.withColumn("kept", verdict).drop("f_lang", "f_source")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    names = ["doc_id", *COUNTS, "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*names, *[F.round(f"{r}_fence", 6).alias(f"{r}_fence") for r in RATES])


def _sql() -> str:
    rates = ", ".join(f"({a} + 0.5::DOUBLE) / ({b} + 1) AS {r}" for r, (a, b, _) in RATES.items())
    bins = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, ceil(ln({r}) / ln({GAMMA}::DOUBLE))::INT AS bucket FROM rated WHERE NOT base_failed" for r in RATES)
    level = "CASE rate " + " ".join(f"WHEN '{r}' THEN {x[2]}" for r, x in RATES.items()) + " END"

    def quantile(keys: str) -> str:
        by = f"{keys}, rate" if keys else "rate"
        return f"""SELECT {by}, docs, pow({GAMMA}::DOUBLE, min(bucket)) AS q FROM (SELECT {by}, bucket, sum(count(*)) OVER (PARTITION BY {by}) AS docs,
          sum(count(*)) OVER (PARTITION BY {by} ORDER BY bucket) AS upto FROM bins GROUP BY {by}, bucket) WHERE 1000 * upto >= {level} * docs GROUP BY {by}, docs"""

    over = " AND ".join(f"{a} - {ERRORS}::DOUBLE * sqrt({a}::DOUBLE) <= {r}_fence * {b} + 1e-9" for r, (a, b, _) in RATES.items())
    shown = ", ".join(f"round({r}_fence, 6) AS {r}_fence" for r in RATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i+1], w[i+2]) AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY k),
c AS (SELECT k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (k)),
rated AS (SELECT *, {rates}, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c),
bins AS ({bins}), own AS ({quantile('lang, source')}), of_lang AS ({quantile('lang')}), of_all AS ({quantile('')}),
groups AS (SELECT DISTINCT lang, source, unnest([{', '.join(f"'{r}'" for r in RATES)}]) AS rate FROM rated),
fence AS (SELECT g.lang, g.source, g.rate, {STRETCH}::DOUBLE * (coalesce(o.docs * o.q, 0.0) + {SHRINK} * ((coalesce(l.docs * l.q, 0.0) + {SHRINK} * coalesce(a.q, 0.0)) / (coalesce(l.docs, 0) + {SHRINK}))) / (coalesce(o.docs, 0) + {SHRINK}) AS f
  FROM groups g LEFT JOIN own o ON g.lang IS NOT DISTINCT FROM o.lang AND g.source IS NOT DISTINCT FROM o.source AND g.rate = o.rate LEFT JOIN of_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate LEFT JOIN of_all a ON g.rate = a.rate),
wide AS (SELECT lang, source, {', '.join(f"max(f) FILTER (rate = '{r}') AS {r}_fence" for r in RATES)} FROM fence GROUP BY 1, 2)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND {over} AS kept, {shown} FROM rated r LEFT JOIN wide x ON r.lang IS NOT DISTINCT FROM x.lang AND r.source IS NOT DISTINCT FROM x.source
"""


ORACLE = _sql()


@carried()
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep. Rows with null or repeated ids are judged one by one; an empty table gives an empty one."""
    keyed = docs.withColumn("_key", row_key(*ROW))
    kept = judged(keyed, "_key").where("kept").select("_key").distinct()
    return keyed.join(kept, "_key", "left_semi").select(*docs.columns)
