"""License scans, DataFrame functions only.

Units are compared with licence templates by the cosine of sparse TF-IDF vectors. Headers (lines, sentences
and paragraphs of a text) are compared with notices, SPDX lines and licences; whole texts with licences.
Ordinary words are no terms. Two bounds on a unit's terms, neither of which loses a match, find the units
worth exploding: see worth().

A licence file is a text that as a whole is a licence, or a file with a licence's name (LICENSE, COPYING,
...) that holds a header. Its licence holds for its directory; a document without a licence of its own
takes that of the nearest ancestor directory that has one, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import only, small_enough, table, written
from inkmill.llm.license_texts import NOTICES, TEXTS

#: Least cosines, and how many terms a unit and its template must share besides: one word alone is no notice.
HEADER, FILE, SHARED = 0.7, 0.7, 2
NAMED = r"(?i)(^|/)(un)?licen[cs]e(s|[.\-_][^/]*)?$|(?i)(^|/)(copying|copyright|notice)([.\-_][^/]*)?$"
#: Directories with a licence file up to which they are broadcast.
MOST_BROADCAST = 200_000
_TERM = re.compile(r"[a-z0-9]+")
#: Ordinary words, which are left out of all vectors.
COMMON = frozenset(
    "a all also an and any are as at been but by can do each either even for from get give had has have how if in into is it its made make may more most must new no nor not of on one only or other others our out s shall should so such "
    "take than that the their them then there therefore these they things this those to unless use used using v want was way we when whether which who will with within without would you your".split()
)
#: More than the rounding of a cosine, which is to six digits.
SLACK = 1e-5


def templates() -> list[tuple[str, bool, str]]:
    """(licence, whether it is a whole licence, text) of each template."""
    names = sorted({*NOTICES, *TEXTS})
    return [(n, False, t) for n, ts in NOTICES.items() for t in ts] + [(n, False, f"SPDX-License-Identifier: {n}") for n in names] + [(n, True, t) for n, t in TEXTS.items()]


def _model() -> tuple[list[tuple[str, int, bool, str, float]], dict[str, float], float]:
    """(licence, template, whole, term, weight of the unit vector) rows; idf by term; idf of any other term."""
    texts = [(name, k, whole, Counter(x for x in _TERM.findall(t.lower()) if x not in COMMON)) for k, (name, whole, t) in enumerate(templates())]
    df = Counter(term for *_, c in texts for term in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for name, k, whole, c in texts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, whole, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*sorted(COMMON)))


def fewest(rows: list[tuple[str, int, bool, str, float]], least: float) -> int:
    """How many of a template's terms a unit must have, for the template of which fewest do, SHARED at least: the squares of the largest weights must reach that of the threshold."""
    found = []
    for k in {r[1] for r in rows}:
        total, n = 0.0, 0
        for w in sorted((r[4] for r in rows if r[1] == k), reverse=True):
            if total >= least * least:
                break
            total, n = total + w * w, n + 1
        found.append(n)
    return max(SHARED, min(found, default=0))


def worth(unit: Column, rows: list[tuple[str, int, bool, str, float]], idf: dict[str, float], other: float) -> Column:
    """False only where no template of rows has a cosine with unit that reaches the threshold.

    For a template w and a unit x, of length 1 and |x|: the cosine is at most |w on the terms that x has|, so
    x has fewest() of the templates' terms or more; and at most |x on those terms| / |x|, where the square
    of the first is at most the largest idf^2 times the square of their number, and x has besides at least
    other^2 for each other word.
    """
    least = min(HEADER, FILE) - SLACK
    few, top = fewest(rows, least), max(idf.values(), default=0.0)
    split = lambda ws: F.struct(F.size(ws).alias("n"), F.filter(ws, lambda x: x.isin(*sorted(idf))).alias("own"))
    let = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)  # noqa: E731  # value is worked out once
    known = lambda v: F.size(v["own"]) * F.size(v["own"]) * F.lit(top * top)
    enough = lambda v: (F.size(F.array_distinct(v["own"])) >= few) & ((1 - least * least) * known(v) >= least * least * (v["n"] - F.size(v["own"])) * F.lit(other * other))
    return let(_terms(unit), lambda ws: let(split(ws), enough))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, path, kind, license, cosine, line): the headers and files of docs(doc_id, path, text) that match, with the best template of each, of equal ones the first licence by name.

    kind is file for a whole text (line -1), else header. Null and empty texts have no units.
    """
    spark: SparkSession = docs.sparkSession
    rows, idf, other = _model()
    whole = [r for r in rows if r[2]]
    weights = spark.createDataFrame(rows, "license string, template int, whole boolean, term string, weight double")
    unit = lambda k, x: F.struct(k.alias("line"), x.alias("unit"))
    parts = lambda sep, at: F.transform(F.split("text", sep), lambda x, k: unit(k + at, x))
    units = F.concat(F.array(unit(F.lit(-1), F.col("text"))), parts("\n", F.lit(0)), parts(r"\n[^\p{L}\p{N}]*\n", F.lit(1 << 28)), parts(r"(?<=[.!?])\s+", F.lit(1 << 29)))
    # a text without some terms has no unit with them
    some = F.size(F.array_distinct(F.filter(_terms(F.col("text")), lambda x: x.isin(*sorted(idf))))) >= fewest(rows, min(HEADER, FILE) - SLACK)
    units = only(docs, "doc_id", "path", "text").where(F.col("text").isNotNull()).where(some).select("doc_id", "path", F.inline(units))
    units = units.where(F.when(F.col("line") < 0, worth(F.col("unit"), whole, idf, other)).otherwise(worth(F.col("unit"), rows, idf, other)))
    units = written(units.withColumn("kind", F.when(F.col("line") < 0, "file").otherwise("header")).withColumn("u", F.xxhash64("unit")), "licensed")
    # rows that share an id and a path are told apart by their units; equal ones add up, which leaves a cosine as it is
    key = ["doc_id", "path", "kind", "line", "u"]
    terms = units.select(*key, F.explode(_terms(F.col("unit"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    # the templates' own terms: fixed in number
    own = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    terms = terms.join(F.broadcast(own), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    meant = terms.where("idf is not null").join(F.broadcast(weights), "term").where("whole or kind = 'header'")
    dots = meant.groupBy(*key, "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("n")).where(F.col("n") >= SHARED)
    dots = dots.groupBy(*key).agg(F.min(F.struct((-F.round("dot", 9)).alias("dot"), F.col("license"))).alias("best"))
    norms = norms.withColumnsRenamed({k: f"n_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    found = dots.join(norms, on).select(*key[:-1], F.col("best.license").alias("license"), F.round(-F.col("best.dot") / F.col("norm"), 6).alias("cosine"))
    return found.where(F.col("cosine") >= F.when(F.col("kind") == "file", FILE).otherwise(HEADER))


def ancestors(path: Column) -> Column:
    """The directories above a path, the root ('') first: a/b/c has '', a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def licensed(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, path, text): doc_id, path, own_license, own_kind, cosine, inherited_license, inherited_from, license.

    own: the best match of the whole text, else of its headers, ties to the first licence by name; inherited: that of
    the nearest ancestor directory holding a licence file (of several files the best, ties alike), for
    documents without their own. Null and empty texts have none of their own; null paths inherit nothing and
    pass nothing on. Rows are told apart by (doc_id, path); repeated rows stay, and rows alike in both but not
    in text have the best of their matches. An empty table gives an empty result.
    """
    docs = only(docs, "doc_id", "path", "text")
    found = written(scanned(docs), "licences")
    order = F.struct("kind", (-F.col("cosine")).alias("c"), "license")
    own = found.groupBy("doc_id", "path").agg(F.min(order).alias("b"))
    own = own.select(F.col("doc_id").alias("o_doc"), F.col("path").alias("o_path"), F.col("b.license").alias("own_license"), F.col("b.kind").alias("own_kind"), (-F.col("b.c")).alias("cosine"))
    rows = docs.select("doc_id", "path")
    out = rows.join(own, F.col("doc_id").eqNullSafe(F.col("o_doc")) & F.col("path").eqNullSafe(F.col("o_path")), "left").drop("o_doc", "o_path")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    files = found.where(F.col("path").isNotNull() & ((F.col("kind") == "file") | F.col("path").rlike(NAMED)))
    holders = written(files.groupBy(directory.alias("directory")).agg(F.min(order)["license"].alias("held")), "holders")
    hint = F.broadcast(holders) if small_enough(holders, MOST_BROADCAST) else holders
    # directories, not documents, look for their nearest holder: one with a third of the documents is one row
    folders = rows.where("path is not null").select(directory.alias("own_directory")).distinct()
    above = folders.select("own_directory", F.posexplode(ancestors(F.concat(F.col("own_directory"), F.when(F.col("own_directory") == "", "x").otherwise("/x")))).alias("depth", "directory"))
    nearest = written(above.join(hint, "directory").groupBy("own_directory").agg(F.max(F.struct("depth", "directory", "held")).alias("a")).select("own_directory", F.col("a.directory").alias("above"), F.col("a.held").alias("held")), "nearest")
    out = out.withColumn("own_directory", directory).join(F.broadcast(nearest) if small_enough(nearest, MOST_BROADCAST) else nearest, "own_directory", "left")
    free = F.col("own_license").isNull()
    return out.select(
        "doc_id", "path", "own_license", "own_kind", "cosine", F.when(free, F.col("held")).alias("inherited_license"), F.when(free, F.col("above")).alias("inherited_from"), F.coalesce("own_license", "held").alias("license")
    )


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    """documents have no path: they lie in a tree of source, then language, under their id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return licensed(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))
