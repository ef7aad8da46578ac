"""Ranked lexical search: the best documents for each item, as a blocked sparse matrix product in 64-bit integers.

Items times terms is one matrix (how often an item has a term), terms times documents the other (the term's
impact in the document). Each task holds the second for a block of documents, sorted by term, and makes the
rows of the product one by one: the postings of an item's terms are added up in one array over the block's
documents (Gustavson's order). A task keeps the TOP best of each item over all its blocks; tasks' lists are
reduced in two steps, so no task gets them all.

All scores are exact: no document, term or item is left out. Items go in blocks of bounded size, so what tasks
are told has a bound; documents are read once for each block of items. Postings are a table in the shared folder.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import only, table, written

TOP = 50
#: Entries of items and terms that tasks are told at a time; postings of a block of documents; lists that are reduced to one, for each item.
ITEM_ENTRIES, DOC_ENTRIES, SALTS = 500_000, 2_000_000, 64
#: Letters and digits of ASCII and all other characters make terms; only A-Z are lower-cased.
_KEPT = (string.ascii_letters + string.digits).encode()
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_BYTES).split()


def _items(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        found = [Counter(terms(x)) for x in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["u", "item_id", "terms", "times"])


def _postings(known):
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, n, ids, tf): all terms of a document, and which of the known ones it has how often."""
        get, many = known.value.get, max(1, len(known.value))
        for batch in it:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                n, lens, flat = [], [], []
                for x in b.column(1).cast(pa.binary()).to_pylist():
                    t = terms(x)
                    n.append(len(t))
                    ids = [i for i in map(get, t) if i is not None]
                    lens.append(len(ids))
                    flat.append(np.array(ids, np.int64))
                key = np.repeat(np.arange(len(n)), lens) * many + np.concatenate(flat) if flat else np.zeros(0, np.int64)
                key, tf = np.unique(key, return_counts=True)
                ends = pa.array(np.searchsorted(key // many, np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array((key % many).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "ids", "tf"])

    return f


def _frequencies(many: int):
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(many, np.int64)
        for b in it:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=many)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["id", "df"])

    return f


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms; beyond 64 bits by Python's integers."""
    if not len(n) or int(n.max()) * 50 * n_docs < 1 << 63:
        return 50 + (50 * n * n_docs) // n_terms
    return np.array([50 + (50 * int(x) * n_docs) // n_terms for x in n], np.int64)


class _Best:
    """The top documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        least = max(1, int(self.score[-1])) if len(self.score) == self.top else 1
        at = np.flatnonzero(score >= least)
        if len(at) > self.top:  # those that tie with the last one stay
            at = at[score[at] >= np.partition(score[at], len(at) - self.top)[len(at) - self.top]]
        if not len(at):
            return
        s, d, z = np.concatenate((self.score, score[at])), np.concatenate((self.doc, doc[at])), np.concatenate((self.null, null[at]))
        order = np.lexsort((d, z, -s))[: self.top]
        self.score, self.doc, self.null = s[order], d[order], z[order]


def _product(told, n_docs: int, n_terms: int, top: int):
    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = told.value
        best, held, entries = [_Best(top) for _ in items], [], 0

        def block() -> None:
            nonlocal held, entries
            t = pa.Table.from_batches(held)
            doc, null = t.column("doc_id").combine_chunks(), t.column("doc_id").is_null().combine_chunks().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            lens = np.concatenate([np.diff(b.column("ids").offsets.to_numpy()) for b in held])
            ids = np.concatenate([b.column("ids").flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column("tf").flatten().to_numpy() for b in held])
            m = length_part(t.column("n").to_numpy(), n_docs, n_terms)
            at = np.repeat(np.arange(len(doc)), lens)
            impact = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
            order = np.argsort(ids, kind="stable")
            at, impact = at[order], impact[order]
            first = np.searchsorted(ids[order], np.arange(len(weights) + 1))
            for (_, own, times), b in zip(items, best, strict=True):
                score = np.zeros(len(doc), np.int64)
                for i, k in zip(own, times, strict=True):
                    x = slice(first[i], first[i + 1])
                    score[at[x]] += k * impact[x]  # a term has a document once
                b.add(score, doc, null)
            held, entries = [], 0

        for batch in it:
            if batch.num_rows:
                held.append(batch)
                entries += len(batch.column("ids").flatten()) + batch.num_rows
                if entries >= DOC_ENTRIES:
                    block()
        if held:
            block()
        for (u, _, _), b in zip(items, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(b.score), pa.int64()), pa.array(b.score), pa.array(b.doc, mask=b.null)], names=["u", "score", "doc_id"])

    return f


def search(docs: DataFrame, items: DataFrame, top: int = TOP, once: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents with a score above 0 of each row of items(item_id, text), over all docs(doc_id, text).

    once: a term of an item counts once; else as often as the item has it. Equal scores are ordered by doc_id, null
    last. Null and empty texts have no terms: such items have no rows, such documents are not counted. Rows of items
    and documents that share an id, or have none, are items and documents of their own. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = written(only(items, "item_id", "text").select(F.monotonically_increasing_id().alias("u"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    rows = written(rows.mapInArrow(_items, "u long, item_id long, terms array<binary>, times array<long>").where(F.size("terms") > 0), "terms")
    blocks = -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_ENTRIES)
    found = spark.createDataFrame([], "u long, score long, doc_id long")
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("u"), F.lit(blocks)) == k).select("u", "terms", "times").collect()
        known = {t: i for i, t in enumerate(sorted({bytes(t) for r in own for t in r.terms}))}
        postings = written(texts.mapInArrow(_postings(spark.sparkContext.broadcast(known)), "doc_id long, n long, ids array<int>, tf array<long>").where("n > 0"), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for r in postings.select("ids").mapInArrow(_frequencies(len(known)), "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
            df[r.id] = r.df
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        told = [(r.u, [known[bytes(t)] for t in r.terms], [1] * len(r.terms) if once else list(r.times)) for r in own]
        told = spark.sparkContext.broadcast((told, weights))
        found = found.union(postings.where(F.size("ids") > 0).mapInArrow(_product(told, n_docs, n_terms, top), "u long, score long, doc_id long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("salt", F.spark_partition_id() % SALTS)
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("u", "salt").orderBy(*order))).where(F.col("k") <= top).drop("k", "salt")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(rows.select("u", "item_id"), "u").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT u, doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT u, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
q AS (SELECT DISTINCT item, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark)),
r AS (SELECT item, any_value(item_id) AS item_id, u, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN wt USING (t), s GROUP BY item, u)
SELECT item_id, row_number() OVER z::INT AS rank, doc_id, score FROM r WHERE score > 0 WINDOW z AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER z <= {TOP}
"""
