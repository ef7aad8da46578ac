"""Near copies by exact similarity: all pairs of texts whose sets of word shingles have Jaccard similarity SIMILARITY or more.

SimHash comes first: fingerprints of all vertices that share anything, each bit the majority over the set's hashes,
are linked within RADIUS bits by the covering tables of op7 (simhash.py), and what they link is verified exactly.

At similarity 0.8 fingerprints differ in up to 24 of 64 bits (decontam.py), for which a covering
family has 2^25 - 1 masks. So the candidates that SimHash leaves come from prefixes: put the shingles of every set in one order,
and sets of similarity s share a shingle among the first n - ceil(s n) + 1 of each. That holds for any
order, so no pair is lost; ours has shingles that are frequent in a sample last, which keeps buckets small.

Equal sets are one vertex. Members of a bucket whose fingerprints agree in BLOCK_BITS bits, others in each round, are compared with
one of them, for as many rounds as that links many; then all pairs of different components are that wide sketches (below) don't rule out
in the join itself. So a group of many near copies takes few comparisons, and none that counts is left out: pairs within a component don't change it.

A pair is compared by sketches first, a bit for each shingle: the parity of the number of shingles that
fall on it. The bits that differ between two sketches are at most the shingles that only one set has, which
a similarity of s bounds; so no pair is lost, and whole sets travel for those alone that pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import ROW, carried, free, numbered, removed, row_key, small_enough, written
from inkmill.llm.graph import components
from inkmill.llm.simhash import BITS, RADIUS, links, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Documents of the sample; how many of them make a shingle frequent; the most frequent ones that are told to all tasks.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 4, 100_000
#: Prefix entries to a partition of buckets; rows up to which a side is broadcast; rounds of comparing with one member, at least and at most.
PART_ROWS, MOST_BROADCAST, ROUNDS, MOST_ROUNDS = 400_000, 300_000, 2, 4
#: Bits of fingerprints by which rounds but the first part a bucket; a round that links fewer than one in so many vertices is the last of them.
BLOCK_BITS, FEW = 12, 1_000
#: Words of the sketches that the last round's join compares; the part of two sets' sizes that may differ.
WIDE, MOST_APART = 8, (1 - SIMILARITY) / (1 + SIMILARITY)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first n - ceil(SIMILARITY n) + 1 of the set s, frequent ones last."""
    # by search: isin() would sort all frequent ones again for each text
    last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
    return np.concatenate((s[~last], s[last]))[: len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1]


def sketch(s: np.ndarray) -> bytes:
    """Bit k of 2^m, as many as shingles at least, is the parity of those that fall on it."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    at = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """Parities by WIDE words of 64 bits for a set of any size: what the last round's join compares, so that it makes no row for a pair that they rule out."""
    at = (s * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32) & np.uint64(64 * WIDE - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * WIDE) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other: never more than the shingles that only one set has."""
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while n > 8 * min(len(a), len(b)):
        n //= 2
        x = (x & ((1 << n) - 1)) ^ (x >> n)
    return (x ^ y).bit_count()


def _close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs(a, b, size_a, size_b, sketch_a, sketch_b) that sketches don't rule out."""
    for batch in it:
        _, _, n, m, x, y = (c.to_pylist() for c in batch.columns)
        ok = [differing(p, q) <= MOST_APART * (i + j) + 1e-9 for p, q, i, j in zip(x, y, n, m, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)))


SAID = "_key long, doc_id long, v long, size long, fp long, sketch binary, wide array<long>, first array<long>"


def _say(frequent: np.ndarray):
    def said(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
                v = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(v), pa.array(size), pa.array(majority(np.concatenate(sets), size.tolist()).view(np.int64)), pa.array([sketch(s) for s in sets], pa.binary()), _lists([wide_sketch(s).view(np.uint64) for s in sets]), _lists([prefix(s, frequent) for s in sets])], names=["_key", "doc_id", "v", "size", "fp", "sketch", "wide", "first"])

    return said


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(t) for t in part.column(1).cast(pa.binary()).to_pylist()])], names=["v", "g"])


def _each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for t in batch.column(0).cast(pa.binary()).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["h"])


def _buckets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entries of a partition whose shingle has several vertices."""
    t = pa.Table.from_batches(batches) if (batches := list(it)) else None
    if t is None or not t.num_rows:
        return
    h, v = t.column("h").to_numpy(), t.column("v").to_numpy()
    order = np.lexsort((v, h))
    h, v = h[order], v[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])))
    order, h = order[new], h[new]
    same = h[1:] == h[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    yield from t.take(pa.array(order[shared])).to_batches(50_000)


def frequent(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    sample = docs.where(F.pmod("_key", F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / max(1, n)))))
    counts = sample.select("text").mapInArrow(_each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.h for r in counts.orderBy(F.col("n").desc(), "h").select("h").limit(MOST_FREQUENT).collect()], np.int64).view(np.uint64))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b")
    n = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", n.alias("n"), (F.size("ga") + F.size("gb") - n).alias("m")).where(F.col("n") >= SIMILARITY * F.col("m") - 1e-9).select("a", "b")


def block_mask(k: int) -> int:
    """The bits of a fingerprint that part buckets in round k: none in the first."""
    at = [(BLOCK_BITS * (k - 1) + i) % BITS for i in range(BLOCK_BITS)] if k else []
    mask = sum(1 << i for i in at)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def merged(label: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """label(node, label) after pairs(a, b) as well. Links are those of components, once each: many pairs between two components are one."""
    if label is None:
        return components(pairs.select(F.col("a").alias("node")), pairs)
    for x in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(x), F.col("label").alias("l")), x, "left").withColumn(x, F.coalesce("l", x)).drop("l")
    pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    now = components(pairs.select(F.col("a").alias("node")), pairs)
    moved = label.join(now.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    after = written(moved.unionByName(now.join(label, "node", "left_anti").select("node", "label")), "labels")
    for x in (pairs, now, label):
        removed(x)
    return after


def by_fingerprint(cards: DataFrame) -> DataFrame:
    """(a, b): pairs of cards(v, fp) whose fingerprints are linked by SimHash, by one vertex of each fingerprint; those of equal fingerprints with that one."""
    points = written(cards.groupBy("fp").agg(F.min("v").alias("o")), "points")
    equal = cards.join(points, "fp").where("v <> o").select(F.col("o").alias("a"), F.col("v").alias("b"))
    of = lambda x: points.select(F.col("fp").alias(x), F.col("o").alias(f"o_{x}"))
    within = links(points.select("fp"), RADIUS).join(of("a"), "a").join(of("b"), "b").select(F.least("o_a", "o_b").alias("a"), F.greatest("o_a", "o_b").alias("b"))
    return equal.unionByName(within)


def labelled(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, label) of docs(_key, doc_id, text): label is the same for rows linked by pairs of similarity SIMILARITY or more. Texts without words are equal."""
    spark = docs.sparkSession
    docs = docs.select("_key", "doc_id", "text")
    said = written(docs.mapInArrow(_say(frequent(docs)), SAID), "said")
    entries = said.select("v", "size", F.posexplode("first").alias("at", "h"))
    n = said.agg(F.sum(F.size("first"))).first()[0] or 0
    buckets = written(entries.repartition(max(8, -(-n // PART_ROWS)), "h").mapInArrow(_buckets, "v long, size long, at int, h long"), "buckets")
    # what pairs are first compared by, and a row of documents that gives the set, of each vertex that shares a bucket
    live = buckets.select("v").distinct()
    cards = written(said.join(live, "v", "left_semi").groupBy("v").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.first("wide").alias("wide"), F.min("_key").alias("_key")), "cards")
    # fingerprints part the buckets
    parted = written(buckets.join(cards.select("v", "fp"), "v"), "parted")
    removed(buckets)
    free(spark)
    label, n_cards = None, cards.count()
    fits = F.least("size", "o_size") >= SIMILARITY * F.greatest("size", "o_size") - 1e-9
    # at the first shingle that two sets share, no more than the rest of either follows; a pair that passes there may fail at later ones
    fits &= F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at")) >= SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("o_size")) - 1e-6

    def members() -> DataFrame:
        if label is None:
            return parted.withColumn("label", F.col("v"))
        return parted.join(label.withColumnsRenamed({"node": "v"}), "v", "left").withColumn("label", F.coalesce("label", "v"))

    # k: the round; -1 for what SimHash links
    k, last = -1, False
    while True:
        if last:
            words = [f"w{i}" for i in range(WIDE)]
            m = members().join(cards.select("v", *[F.get("wide", F.lit(i)).alias(w) for i, w in enumerate(words)]), "v")
            others = m.select("h", F.col("v").alias("o_v"), F.col("size").alias("o_size"), F.col("at").alias("o_at"), F.col("label").alias("o_label"), *[F.col(w).alias(f"o_{w}") for w in words])
            apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in words[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("o_w0"))))
            found = m.join(others, "h").where("label <> o_label and v < o_v").where(apart <= MOST_APART * (F.col("size") + F.col("o_size")) + 1e-9)
        elif k >= 0:
            m = members().withColumn("block", F.col("fp").bitwiseAND(F.lit(block_mask(k))))
            one = m.groupBy("h", "block").agg(F.min(F.struct(F.xxhash64(F.lit(k), "h", "v").alias("o"), "v", "size", "at", "label")).alias("x"))
            one = one.select("h", "block", F.col("x.v").alias("o_v"), F.col("x.size").alias("o_size"), F.col("x.at").alias("o_at"), F.col("x.label").alias("o_label"))
            found = m.join(one, ["h", "block"]).where("label <> o_label")
        found = found.where(fits).select(F.least("v", "o_v").alias("a"), F.greatest("v", "o_v").alias("b")).distinct() if k >= 0 else by_fingerprint(cards.select("v", "fp"))
        for x in ("a", "b"):
            found = found.join(cards.select(F.col("v").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
        pairs = written(found.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_close, "a long, b long"), "pairs")
        needed = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
        needed = written(cards.select("v", "_key").join(needed, "v"), "needed")
        near = F.broadcast(needed) if small_enough(needed, MOST_BROADCAST) else needed
        sets = written(docs.join(near, "_key").groupBy("v").agg(F.first("text").alias("text")).mapInArrow(_sets, "v long, g array<long>"), "sets")
        more = written(verified(pairs, sets), "near")
        for x in (pairs, needed, sets):
            removed(x)
        free(spark)
        joined = more.count()
        if joined:
            label = merged(label, more)
        if last:
            return _named(said, label)
        k += 1
        last = k > 0 and (not joined or k == MOST_ROUNDS or (k >= ROUNDS and joined * FEW < n_cards))


def _named(said: DataFrame, label: DataFrame | None) -> DataFrame:
    rows = said.select("_key", "doc_id", "v")
    if label is None:
        return rows.select("_key", "doc_id", F.col("v").alias("label"))
    return rows.join(label.withColumnRenamed("node", "v"), "v", "left").select("_key", "doc_id", F.coalesce("label", "v").alias("label"))


@carried()
def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: the one of the least doc_id, those without an id last."""
    rows = labelled(docs.withColumn("_key", row_key(*ROW)))
    first = written(rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key")).select("_key"), "first")
    return numbered(docs, *ROW).where("_n = 1").join(first, "_key", "left_semi").select(*docs.columns)
