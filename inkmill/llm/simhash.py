"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its word
shingles. Pairs within RADIUS bits are found by a covering family: every bit position gets a vector
m(i) of RADIUS + 1 bits; for each non-zero v of that length there is a table whose mask keeps the
positions with <m(i), v> odd. A pair that differs in at most RADIUS positions spans at most RADIUS
vectors, so some v is orthogonal to all of them, and the pair agrees on that table's mask: none is lost.

Equal fingerprints are one vertex before any join, so copies never make pairs. A vertex has at most as
many links as the radius-3 ball has points (43,744), whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import only, table, written
from inkmill.llm.graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
_LANES = np.uint64(0x0001000100010001)


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius + 1) - 1 masks. Vectors are dealt in turn, non-zero ones only, so that each mask keeps about half of the positions."""
    n = 1 << (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n)]


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the lower-cased (A-Z) words; one of the whole sequence if it is shorter; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1]
    return [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The fingerprint of each run of hashes. Sixteen sums of four 16-bit lanes stand for the 64 counts; runs are cut at 60,000 so that no lane overflows."""
    out = np.zeros(len(lengths), np.uint64)
    starts, owner, at = [], [], 0
    for k, n in enumerate(lengths):
        for a in range(0, n, 60_000):
            starts.append(at + a)
            owner.append(k)
        at += n
    if not starts:
        return out
    counts = np.zeros((len(lengths), BITS), np.int64)
    for shift in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
        for lane in range(4):
            np.add.at(counts[:, shift + 16 * lane], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    ones = 2 * counts > np.asarray(lengths, np.int64)[:, None]
    for bit in range(BITS):
        out |= ones[:, bit].astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints_of(texts: list[bytes | None], size: int = SHINGLE, chunk: int = 200_000) -> np.ndarray:
    """Fingerprints of whole texts, some hundred thousand shingles at a time (one text's at least)."""
    done, held, lengths, n = [], [], [], 0
    for text in texts:
        hs = shingle_hashes(text, size)
        held.append(np.array(hs, np.uint64))
        lengths.append(len(hs))
        n += len(hs)
        if n >= chunk:
            done.append(majority(np.concatenate(held), lengths))
            held, lengths, n = [], [], 0
    if lengths:
        done.append(majority(np.concatenate(held), lengths))
    return np.concatenate(done) if done else np.zeros(0, np.uint64)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fp = fingerprints_of(texts).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null and wordless texts have 0."""
    return only(docs, "doc_id", "text").mapInArrow(_batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints in points(fp) that differ in at most radius bits."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(BITS, radius)])
    keyed = points.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # a bucket of one has no pair: its rows need not travel twice
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = keyed.join(full, ["t", "key"])
    a, b = shared.withColumnRenamed("fp", "a"), shared.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links of at most radius bits, itself included.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay; an empty
    table gives an empty result; rows whose doc_id is null stay, and never name a component of others.
    """
    fps = written(fingerprints(docs), "fp")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "points")
    label = components(points.select(F.col("fp").alias("node")), links(points.select("fp")))
    named = points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_fp = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
