"""Stupid-backoff scores: n-gram counts partitioned by hash, joined to each document's n-grams, summed.

Documents lie in blocks by the hash of their id. A block sends each hash partition its distinct n-grams
and their counts as one row of packed, sorted hashes; the partition adds up what all blocks sent and
answers each block in the same order, so the answer needs no hashes; the block joins it to its n-grams
and sums per document. What travels is a few bytes for each distinct n-gram of a block, not a row.

S(w | u v) = c(uvw) / c(uv) if c(uvw) >= LEAST, else BACKOFF * S(w | v); S(w | v) alike; S(w) = c(w) / N.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import free, only, table, written

ORDER, BACKOFF, LEAST = 3, 0.4, 2
BLOCK_BYTES = 16 << 20
#: Bits of an n-gram's hash beyond log2 of the corpus's bytes: another n-gram has the same with a chance under 2^-20.
SPARE_BITS = 20


def pack(x: np.ndarray) -> bytes:
    """Sorted or small numbers: differences, split into planes of bytes, compressed."""
    d = np.diff(x, prepend=np.uint64(0)) if len(x) else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8")[:, 0], dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8")[:, 0].astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes x in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class _Grams:
    """The n-grams of a block's texts: for each order, a hash per token whose context is inside its text. One order is in memory at a time."""

    def __init__(self, texts: list[bytes], order: int):
        seen: dict[bytes, int] = {}
        digest = xxhash.xxh3_64_intdigest
        tokens, lengths = [], []
        for text in texts:
            words = text.lower().split()
            lengths.append(len(words))
            for w in words:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = digest(w)
                tokens.append(h)
        self.h = np.array(tokens, np.uint64)
        del tokens, seen
        self.order, self.lengths = order, np.array(lengths, np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        #: words before each token in its text, order at most
        self.before = np.full(len(self.h), order, np.uint16)
        for k in range(order):
            self.before[self.begin[self.lengths > k] + k] = k

    def each(self, bits: int, places: bool):
        """For each order in turn: distinct hashes ascending, which of them each token has (the tokens with enough words before them, if places), their counts."""
        gram = _mix(self.h.copy())
        for k in range(self.order):
            if k:
                # the gram of order k + 1 that ends at each token: that of order k ending before it, and the token
                gram[1:] = gram[:-1]
                gram[:1] = 0
                gram *= np.uint64(0x9E3779B97F4A7C15)
                gram += self.h
                _mix(gram)
            x, at = gram[self.before >= k] >> np.uint64(64 - bits), None
            if places:
                array = np.argsort(x)
                x = x[array]
            else:
                x.sort()
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            heads = np.flatnonzero(new)
            if places:
                at = np.empty(len(x), np.int32)
                at[array] = np.cumsum(new, dtype=np.int32) - 1
                del array
            x = x[heads]
            yield k, x, at, np.diff(np.append(heads, len(new)))


def _texts(rows: pa.Table) -> list[bytes]:
    return [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]


def _bounds(x: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's hashes begin in x: shards are equal ranges."""
    edges = np.array([(k << bits) // shards for k in range(shards)], np.uint64)
    return np.append(np.searchsorted(x, edges), len(x))


SENT = "shard long, block long, tokens long, grams array<binary>, counts array<binary>"
ANSWER = "block long, shard long, tokens long, totals array<binary>"


def _send(order: int, bits: int, shards: int):
    # shards in which a block has no n-gram get no row, so rows are at most the n-grams, however many blocks and shards there are
    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        out = [{"shard": s, "block": block, "tokens": 0, "grams": [], "counts": []} for s in range(shards)]
        for k, x, _, n in _Grams(_texts(rows), order).each(bits, False):
            bounds = _bounds(x, shards, bits)
            for row, lo, hi in zip(out, bounds, bounds[1:], strict=False):
                row["grams"].append(pack(x[lo:hi]))
                row["counts"].append(pack_counts(n[lo:hi]))
                row["tokens"] += int(n[lo:hi].sum()) if not k else 0
                row["some"] = row.get("some") or hi > lo
        out = [{k: v for k, v in row.items() if k != "some"} for row in out if row["some"]]
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("tokens", pa.int64()), ("grams", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]))

    return run


def _answer(order: int, least: int):
    def run(rows: pa.Table) -> pa.Table:
        t = rows.to_pydict()
        totals: list[list[bytes]] = [[] for _ in t["block"]]
        for k in range(order):
            grams = [unpack(g[k]) for g in t["grams"]]
            ends = np.cumsum([len(g) for g in grams])
            every, at = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate([unpack_counts(c[k]) for c in t["counts"]]))
            # what the model leaves out is told as 0
            told = total if k == 0 else np.where(total >= least, total, 0)
            for j, part in enumerate(np.split(told[at], ends[:-1])):
                totals[j].append(pack_counts(part))
        return pa.table({"block": pa.array(t["block"], pa.int64()), "shard": pa.array(t["shard"], pa.int64()), "tokens": pa.array(t["tokens"], pa.int64()), "totals": pa.array(totals, pa.list_(pa.binary()))})

    return run


SCORED = "doc_id long, n_tokens long, log_score double, n_backed_off long"


def _score(order: int, bits: int, n: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = _Grams(_texts(rows), order)
        size = len(g.h)
        score, backed, last = np.zeros(size), np.zeros(size, bool), None
        t = answers.sort_by("shard").column("totals").to_pylist()
        # upwards: a known n-gram's own ratio takes the place of what its token had from the order below
        for k, x, at, _ in g.each(bits, True):
            total = np.concatenate([unpack_counts(a[k]) for a in t]) if size else np.zeros(0, np.int64)
            assert len(total) == len(x), "a block and its answers differ"
            has = g.before >= k
            count = np.zeros(size, np.int64)
            count[has] = total[at]
            del total, at, x
            known = np.flatnonzero(count > 0)
            if k:
                missing = has & (count == 0)
                score[missing] += math.log(BACKOFF)
                backed[has] = missing[has]
            score[known] = np.log(count[known] / (last[known - 1] if k else n))
            last = count
        some = g.lengths > 0
        sums, off = np.zeros(len(g.lengths)), np.zeros(len(g.lengths), np.int64)
        if size:
            sums[some], off[some] = np.add.reduceat(score, g.begin[some]), np.add.reduceat(backed.astype(np.int64), g.begin[some])
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(g.lengths), "log_score": pa.array(sums), "n_backed_off": pa.array(off)})

    return run


def scored(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, log_score (natural logarithm, summed), n_backed_off, mean_log_score, perplexity.

    The model is of all rows; bigrams and trigrams seen less than `least` times are unknown to it (1: none is).
    Words are lower-cased (A-Z) and split at ASCII white space; the first words
    of a text use the orders they have. Null and empty texts have no tokens, score 0 and null means.
    Repeated rows count, and are scored, as rows of their own. An empty table gives an empty result.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, max(40, size.bit_length() + SPARE_BITS))
    blocks = max(8, -(-size // BLOCK_BYTES))
    shards = 2 * blocks
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(blocks, "block")
    sent = docs.groupBy("block").applyInArrow(_send(order, bits, shards), SENT)
    answers = written(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_answer(order, least), ANSWER), "answers")
    del sent
    free(docs.sparkSession)
    n = answers.agg(F.sum("tokens")).first()[0] or 0
    out = docs.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_score(order, bits, n), SCORED)
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("log_score") / F.col("n_tokens"), 6))
    return out.withColumn("log_score", F.round("log_score", 6)).withColumn("mean_log_score", mean).withColumn("perplexity", F.round(F.exp(-F.col("mean_log_score")), 3))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT k, w[p] AS c, CASE WHEN p > 1 THEN w[p-1] END AS b, CASE WHEN p > 2 THEN w[p-2] END AS a, p FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
one AS (SELECT c, count(*) AS n FROM t GROUP BY ALL), two AS (SELECT b, c, count(*) AS n FROM t WHERE p > 1 GROUP BY ALL), three AS (SELECT a, b, c, count(*) AS n FROM t WHERE p > 2 GROUP BY ALL),
x AS (SELECT t.k, t.p, o.n AS n1, w.n AS n2, h.n AS n3, ob.n AS nb, wab.n AS nab, (SELECT count(*) FROM t) AS whole FROM t JOIN one o ON t.c = o.c LEFT JOIN two w ON t.b = w.b AND t.c = w.c LEFT JOIN three h ON t.a = h.a AND t.b = h.b AND t.c = h.c
  LEFT JOIN one ob ON t.b = ob.c LEFT JOIN two wab ON t.a = wab.b AND t.b = wab.c),
s AS (SELECT k, CASE WHEN p > 2 AND n3 >= {LEAST} THEN ln(n3 / nab) WHEN p > 1 AND n2 >= {LEAST} THEN ln(n2 / nb) + (p > 2)::INT * ln({BACKOFF}::DOUBLE) ELSE ln(n1 / whole) + least(p - 1, 2) * ln({BACKOFF}::DOUBLE) END AS s,
  CASE WHEN p > 2 THEN n3 < {LEAST} WHEN p > 1 THEN n2 < {LEAST} ELSE false END AS off FROM x),
g AS (SELECT k, count(*) AS n_tokens, sum(s) AS log_score, count(*) FILTER (off) AS n_backed_off FROM s GROUP BY k)
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(round(log_score, 6), 0.0) AS log_score, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off,
  round(round(log_score, 6) / n_tokens, 6) AS mean_log_score, round(exp(-round(round(log_score, 6) / n_tokens, 6)), 3) AS perplexity FROM d LEFT JOIN g USING (k)
"""
