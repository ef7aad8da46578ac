"""Benchmark decontamination, DataFrame functions only.

A window of a document is as long as a benchmark item, at any offset. Two sets of shingles, counted with
repeats, of sizes a and b have a similarity of s only if they share s / (1 + s) * (a + b) or more; so of all
windows, those that hold so many of the item's shingles, in whatever order, get a SimHash fingerprint, and
leaving out the others loses nothing. Fingerprints are cut into RADIUS + 1 blocks; two that differ in at
most RADIUS bits agree in a block, so joining on (item, block, value) finds all within the radius; the
multiset Jaccard similarity of shingles then verifies each exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import carried, only, small_enough, table, written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.6 bits on average, with a deviation of 2.9: the radius lies five deviations above.
BITS, RADIUS = 64, 24
#: Rows up to which a side is broadcast; beyond it, joins shuffle.
MOST_BROADCAST = 300_000


def shingled(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n (words of text, lower-cased, punctuation apart) and g, the hashes of its shingles; a shorter text has one of all its words, an empty one none."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")
    df = df.select(*keys, w.alias("w"))
    many = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(SHINGLE)]))
    g = F.when(F.size("w") >= SHINGLE, many).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*keys, F.size("w").alias("n"), g.alias("g"))


def fingerprint(total: Column, count_of: list[Column]) -> Column:
    """Bit k is one if count_of[k] is over half of total."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(2 * c > total, F.lit((1 << k) - ((1 << 64) if k == 63 else 0))).otherwise(F.lit(0)) for k, c in enumerate(count_of)])


def hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, total, fp of rows(keys, h, c): the SimHash of each key's shingles h, counted c times. 32 sums of two 32-bit lanes stand for 64 counts."""
    lanes = [F.sum(F.col("c") * F.shiftrightunsigned("h", b).bitwiseAND(F.lit(0x0000000100000001))).alias(f"l{b}") for b in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("c").alias("total"), *lanes)
    counts = [F.col(f"l{k % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(F.col(f"l{k % 32}"), 32) for k in range(BITS)]
    return sums.select(*keys, "total", fingerprint(F.col("total"), counts).alias("fp"))


def blocks(fp: str) -> Column:
    """The values of the RADIUS + 1 blocks of a fingerprint."""
    ends = [round(BITS * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:], strict=False)])


def keyed_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): item tells rows of different ids or texts apart, rows without an id too."""
    return only(benchmark, "item_id", "text").withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", F.col("text").isNull(), "text"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item, start, similarity): the windows found, at their word offset. th is the hash of the row's text, item the key of keyed_items()."""
    keyed = only(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    items = shingled(keyed_items(benchmark).dropDuplicates(["item"]), "item").where("n > 0")
    items = written(items, "items")
    item_counts = written(items.select("item", F.explode("g").alias("h")).groupBy("item", "h").agg(F.count("*").alias("ci")), "item-shingles")
    bounded = small_enough(item_counts, MOST_BROADCAST)
    hint = F.broadcast if bounded else (lambda x: x)

    # where shingles of items stand: a place of a document once for each item
    # outer: else the optimizer would infer a filter from the explode and compute the words again for each shingle
    g = shingled(keyed, "doc_id", "th")
    places = item_counts.join(items.select("item", F.col("n").alias("item_n"), F.size("g").alias("size")), "item").drop("ci")
    hits = g.select("doc_id", "th", F.col("n").alias("doc_n"), F.posexplode_outer("g").alias("p", "h")).join(hint(places), "h")
    hits = written(hits.select("doc_id", "th", "doc_n", "p", "item", "item_n", "size"), "hits")
    # as long as a part of the document's own list of shingles
    lined = hits.groupBy("doc_id", "th", "item", "doc_n", "item_n", "size").agg(F.array_sort(F.collect_set("p")).alias("p"))
    length = F.greatest(F.lit(1), F.least("item_n", "doc_n") - SHINGLE + 1)
    lined = lined.withColumn("length", length).withColumn("need", F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("length")) - 1e-9).cast("int")).where(F.size("p") >= F.col("need"))
    # places i .. i + need - 1 lie in a window that starts no later than the first and ends no earlier than the last
    last = F.greatest(F.lit(0), F.col("doc_n") - F.col("item_n"))
    # as an array of one range, so that it is worked out once
    span = lambda i: F.struct(F.greatest(F.get("p", i + F.col("need") - 1) - F.col("length") + 1, F.lit(0)).alias("a"), F.least(F.get("p", i), last).alias("z"))
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), span), lambda x: x["a"] <= x["z"])
    starts = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["z"]))))
    windows = written(lined.select("doc_id", "th", "item", "size", F.explode(starts).alias("start"), F.col("length")), "windows")

    # the shingles of those windows alone, from the documents that have one
    owners = windows.select(F.col("doc_id").alias("o_doc"), F.col("th").alias("o_th")).distinct()
    owners = F.broadcast(owners) if small_enough(owners, MOST_BROADCAST) else owners
    held = keyed.join(owners, keyed.doc_id.eqNullSafe(owners.o_doc) & (keyed.th == owners.o_th), "left_semi").dropDuplicates(["doc_id", "th"])
    held = shingled(held, "doc_id", "th").withColumnsRenamed({"doc_id": "h_doc", "th": "h_th"})
    inside = windows.join(held, windows.doc_id.eqNullSafe(held.h_doc) & (windows.th == held.h_th))
    inside = inside.select("doc_id", "th", "item", "size", "start", F.explode_outer(F.slice("g", F.col("start") + 1, F.col("length"))).alias("h"))
    key = ["doc_id", "th", "item", "size", "start"]
    counted = written(inside.groupBy(*key, "h").agg(F.count("*").alias("c")), "counted")

    # written, or the optimizer would copy their 64 cases into each of the blocks
    window_fp = written(hashed(counted, *key), "window-prints")
    item_fp = written(hashed(item_counts.withColumnRenamed("ci", "c"), "item"), "item-prints").select(F.col("item").alias("i_item"), F.col("fp").alias("i_fp"))
    by_block = window_fp.select(*key, "total", "fp", F.posexplode(blocks("fp")).alias("b", "v"))
    items_by_block = item_fp.select("i_item", "i_fp", F.posexplode(blocks("i_fp")).alias("i_b", "i_v"))
    near = by_block.join(items_by_block, (F.col("item") == F.col("i_item")) & (F.col("b") == F.col("i_b")) & (F.col("v") == F.col("i_v")))
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp"))) <= RADIUS).select(*key, "total").distinct()

    shared = counted.join(item_counts, ["item", "h"]).groupBy(*key).agg(F.sum(F.least("c", "ci")).alias("shared"))
    shared = shared.withColumnsRenamed({k: f"s_{k}" for k in key})
    on = reduce(lambda x, y: x & y, [near[k].eqNullSafe(shared[f"s_{k}"]) for k in key])
    similarity = F.col("shared") / (F.col("size") + F.col("total") - F.col("shared"))
    return near.join(shared, on).withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY).select("doc_id", "th", "item", "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, contaminated, n_items, item_ids (ascending), similarity (the highest; null if none).

    Rows with null or empty text match nothing, nor do items without words. Benchmark rows that repeat an
    item_id with different texts are matched one by one; those without an id count as items of n_items, one
    for each text, but have no place in item_ids. An item or document of fewer than five words has one shingle, the whole of it, so
    they match each other only if equal. Repeated documents each have their row. Empty tables match nothing.
    """
    found = written(matches(docs, benchmark), "matches")
    ids = keyed_items(benchmark).select("item", "item_id").distinct()
    found = found.join(F.broadcast(ids) if small_enough(ids, MOST_BROADCAST) else ids, "item")
    nameless = F.count_distinct(F.when(F.col("item_id").isNull(), F.col("item"))).alias("nameless")
    per = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), nameless, F.round(F.max("similarity"), 6).alias("similarity"))
    per = per.withColumnsRenamed({"doc_id": "m_doc", "th": "m_th"})
    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(per, rows.doc_id.eqNullSafe(per.m_doc) & (rows.th == per.m_th), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), (F.size(ids) + F.coalesce("nameless", F.lit(0))).cast("long").alias("n_items"), ids.cast("array<bigint>").alias("item_ids"), "similarity")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    shingles = lambda key, t: f"""SELECT {key}, len(w) AS n, CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS g
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {t})"""  # noqa: E731
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents), bench AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS ({shingles('k', 'docs')}), i AS (SELECT *, len(g) AS size FROM ({shingles('item', 'bench')}) WHERE n > 0),
ih AS (SELECT item, h, count(*) AS ci FROM (SELECT item, unnest(g) AS h FROM i) GROUP BY ALL), dh AS (SELECT k, unnest(g) AS h, generate_subscripts(g, 1) - 1 AS p FROM d),
hits AS (SELECT k, item, h, ci, p, size, greatest(1, least(i.n, d.n) - {SHINGLE - 1}) AS length, greatest(0, d.n - i.n) AS last FROM dh JOIN ih USING (h) JOIN i USING (item) JOIN d USING (k)),
starts AS (SELECT DISTINCT k, item, size, length, unnest(range(greatest(0, p - length + 1), least(p, last) + 1)) AS start FROM hits),
c AS (SELECT s.k, s.item, s.start, s.size, s.length, h, any_value(ci) AS ci, count(*) AS cd FROM starts s JOIN hits t ON s.k = t.k AND s.item = t.item AND t.p BETWEEN s.start AND s.start + s.length - 1 GROUP BY ALL),
sim AS (SELECT k, item, sum(least(ci, cd)) / (any_value(size) + any_value(length) - sum(least(ci, cd))) AS similarity FROM c GROUP BY k, item, start),
m AS (SELECT k, item, max(similarity) AS similarity FROM sim WHERE similarity >= {SIMILARITY} GROUP BY k, item),
f AS (SELECT k, count(DISTINCT item) FILTER (item_id IS NULL) AS nameless, coalesce(list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)), []::BIGINT[]) AS item_ids, round(max(similarity), 6) AS similarity FROM m JOIN bench USING (item) GROUP BY k)
SELECT doc_id, f.k IS NOT NULL AS contaminated, (coalesce(len(item_ids), 0) + coalesce(nameless, 0))::BIGINT AS n_items, coalesce(item_ids, []::BIGINT[]) AS item_ids, similarity FROM docs LEFT JOIN f USING (k)
"""


ORACLE = _sql()


@carried()
def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no benchmark item. Rows are told apart by id and text, null ids too; those with null or empty text stay, as do all if either table is empty."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("b_doc"), F.col("th").alias("b_th")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.b_doc) & (F.xxhash64(docs.text) == bad.b_th), "left_anti")
