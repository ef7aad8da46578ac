"""Suffix-array dedup: a logarithmic index family over the stretches of text that may repeat.

A byte goes if it lies in a 100-byte string that also starts earlier (smaller doc_id, or earlier in the
same document). Indexing every suffix of the corpus would write many times the corpus; so first:

1. Stretches. Every 100-byte window has a least hash among its 24-byte pieces; consecutive windows with
   the same such piece form a stretch, and equal windows have equal hashes. Blocks of documents tell the
   partition of each hash whether they hold it once, more often, or with several contents, one row per
   block and hash. A hash that occurs once in the corpus can't be part of a repeat and goes no further.
   If all stretches of a hash are the same string, they are one entry, and its first place is known.
2. Stretches that share a hash but differ are indexed. A partition takes them in batches, in the order
   of their places: each batch gets its suffix array (its windows sorted by their 100 bytes), is
   merge-scanned against the existing levels, and becomes a level; levels of about equal size merge, so
   there are logarithmically many. What a scan finds is an earlier copy. Hashes with very many different
   stretches (the edges of a passage that a third of the documents share) are cut into cells: windows whose
   distances to the piece lie in one range of CELL, known by the bytes that all of them have. Most cells at an
   edge occur once. Those that still have very many contents are cut into windows known by 128-bit
   fingerprints, which spread over all partitions. Cells and windows go through the same index.
3. Removed runs return to their block and are cut out of its documents.

Nothing is compared across documents in pairs, and what a block says of a hash is one row, however often
it occurs there. Equality of whole stretches is that of two 64-bit hashes; of indexed windows, of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import ROW, carried, free, only, small_enough, table, written

DEPTH, PIECE = 100, 24
#: Text of a block, about; windows of a batch; stretches of a hash over which it is cut into cells, and cells over which they are cut into windows; windows of a cell.
BLOCK_BYTES, BATCH_WINDOWS, HOT, CELL = 8 << 20, 50_000, 256, 16
#: Windows that a partition has in memory at a time, about; bytes of a mark, which stands for a window of a cut cell; cut cells up to which they are broadcast.
INDEX_WINDOWS, MARK, MOST_CUT = 400_000, 16, 500_000
_LAST = (1 << 63) - 1
ALL, FIRST, MIXED, CUT = 0, 1, 2, 3


class LogIndex:
    """Levels of sorted windows, each at least twice as large as the next: the suffix arrays of what was added, cut at a fixed depth."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """For each window of a batch (fixed-width bytes, in the order of their places): whether it occurred earlier."""
        array = np.argsort(windows, kind="stable")
        ordered = windows[array]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        known = np.zeros(int(first.sum()), bool)
        fresh = ordered[first]
        for level in self.levels:
            at = np.searchsorted(level, fresh)
            inside = at < len(level)
            known[inside] |= level[at[inside]] == fresh[inside]
        earlier = np.ones(len(ordered), bool)
        earlier[first] = known
        out = np.empty(len(ordered), bool)
        out[array] = earlier
        self.levels.append(fresh[~known])
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            both = np.concatenate((self.levels.pop(), self.levels.pop()))
            both.sort(kind="stable")
            self.levels.append(both)
        return out


def windows_of(content: bytes) -> np.ndarray:
    """All DEPTH-byte windows of content. UTF-8 has no byte 255, so adding one keeps order and leaves no zero, which numpy would strip."""
    raw = np.frombuffer(content, np.uint8) + np.uint8(1)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, DEPTH)).view(f"S{DEPTH}")[:, 0]


def _pieces(text: bytes) -> np.ndarray:
    """The hash of each piece of text."""
    n = len(text)
    eight = np.ndarray((n - 7,), "<u8", text, 0, (1,)).copy()
    pieces = n - PIECE + 1
    h = eight[:pieces] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, PIECE, 8):
        h ^= h >> np.uint64(29)
        h += eight[at : at + pieces]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each stretch of text."""
    if len(text) < DEPTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _pieces(text)
    wide, step, least = DEPTH - PIECE + 1, 1, h
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    # a stretch ends with the window that begins at its anchor, the leftmost piece of least hash: no window recurs within a stretch
    edge = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    starts = np.concatenate(([0], np.flatnonzero(edge) + 1))
    lengths = np.diff(np.concatenate((starts, [len(least)])))
    return least[starts], starts, lengths


class _Block:
    """The stretches of a block's documents, in the order of their places. Rows that repeat a doc_id stand in the order of their texts."""

    def __init__(self, rows: pa.Table):
        ids = [_LAST if x is None else x for x in rows.column("doc_id").to_pylist()]
        texts = [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.rows = rows.take(pa.array(order, pa.int64()))
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        # the place of a window: the document, and where it starts; a repeated doc_id starts beyond the row before it
        base, at = [], 0
        for k, i in enumerate(self.ids):
            at = at + len(self.texts[k - 1]) + 1 if k and self.ids[k - 1] == i else 0
            base.append(at)
        self.base = base

    def read(self) -> None:
        digest = xxhash.xxh3_64_intdigest
        a, start, n, owner, h = [], [], [], [], []
        for k, text in enumerate(self.texts):
            x, s, m = stretches(text)
            a.append(x)
            start.append(s)
            n.append(m)
            owner.append(np.full(len(x), k))
            h.append(np.fromiter((digest(text[p:q]) for p, q in zip(s.tolist(), (s + m + DEPTH - 1).tolist(), strict=True)), np.uint64, len(x)))
        self.a, self.start, self.n, self.owner, self.h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, start, n, owner, h))
        self.doc = np.array(self.ids, np.int64)[self.owner] if len(self.owner) else np.zeros(0, np.int64)
        self.at = self.start + np.array(self.base, np.int64)[self.owner] if len(self.owner) else np.zeros(0, np.int64)

    def runs(self, owner: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"k": pa.array(owner, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64())})


def _u(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


SAID = "a long, h long, contents int, n long, doc long, at long, block long"


def _say(rows: pa.Table) -> pa.Table:
    """One row for each hash of a block: its first stretch, how many different contents, how many stretches."""
    b = _Block(rows)
    b.read()
    order = np.lexsort((b.h, b.a))
    a, h = b.a[order], b.h[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    new_h = new_a | np.concatenate(([True], h[1:] != h[:-1])) if len(a) else new_a
    heads = np.flatnonzero(new_a)
    contents = np.add.reduceat(new_h.astype(np.int32), heads) if len(heads) else np.zeros(0, np.int32)
    count = np.diff(np.concatenate((heads, [len(a)])))
    first = np.minimum.reduceat(order, heads) if len(heads) else heads  # stretches stand in the order of their places
    block = rows.column("block")[0].as_py()
    return pa.table({
        "a": _u(a[heads]), "h": _u(h[heads]), "contents": pa.array(contents, pa.int32()), "n": pa.array(count, pa.int64()), "doc": pa.array(b.doc[first], pa.int64()),
        "at": pa.array(b.at[first], pa.int64()), "block": pa.array(np.full(len(heads), block), pa.int64()),
    })


TOLD = "block long, a long, kind int"


def _tell(hot: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all that blocks said of the hashes of a partition: what each has to do. Hashes that occur once are not told of."""
        batches = list(it)
        if not batches:
            return
        t = {n: np.concatenate([x.column(i).to_numpy() for x in batches]) for i, n in enumerate(batches[0].schema.names)}
        order = np.lexsort((t["at"], t["doc"], t["a"]))
        t = {k: v[order] for k, v in t.items()}
        a = t["a"]
        heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        rows = np.diff(np.concatenate((heads, [len(a)])))
        total = np.add.reduceat(t["n"], heads)
        contents = np.add.reduceat(t["contents"], heads)
        same = (np.minimum.reduceat(t["h"], heads) == np.maximum.reduceat(t["h"], heads)) & (np.maximum.reduceat(t["contents"], heads) == 1)
        kind = np.where(same, ALL, np.where(contents > hot, CUT, MIXED))
        each = np.repeat(kind, rows)
        each[heads[same]] = FIRST
        sent = np.repeat(total > 1, rows)
        yield pa.RecordBatch.from_arrays([pa.array(t["block"][sent]), pa.array(a[sent]), pa.array(each[sent], pa.int32())], names=["block", "a", "kind"])

    return run


#: runs: row k of the block, windows start .. start + n - 1 removed. entries: the rest, for the index.
FOUND = "block long, k long, start long, n long, key long, doc long, at long, content binary"


def _find(rows: pa.Table, told: pa.Table) -> pa.Table:
    out: list[pa.Table] = []
    if rows.num_rows and told.num_rows:
        b = _Block(rows)
        b.read()
        block = rows.column("block")[0].as_py()
        ta = told.column("a").to_numpy().view(np.uint64)
        order = np.argsort(ta)
        ta, kinds = ta[order], told.column("kind").to_numpy()[order]
        at = np.minimum(np.searchsorted(ta, b.a), len(ta) - 1)
        kind = np.where(ta[at] == b.a, kinds[at], -1)
        order = np.lexsort((b.h, b.a))
        a, h = b.a[order], b.h[order]
        first = np.zeros(len(a), bool)
        if len(a):
            first[order[np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))]] = True  # lexsort is stable: the earliest of each content
        gone = (kind == ALL) | ((kind != -1) & ~first)
        out.append(_rows(block, b.owner[gone], b.start[gone], b.n[gone]))
        mixed = np.flatnonzero((kind == MIXED) & first)
        out.append(_rows(block, b.owner[mixed], b.start[mixed], b.n[mixed], b.a[mixed], b.doc[mixed], b.at[mixed], [b.texts[k][s : s + n + DEPTH - 1] for k, s, n in zip(b.owner[mixed], b.start[mixed], b.n[mixed], strict=True)]))
        out += _cut_up(b, block, np.flatnonzero((kind == CUT) & first))
    return pa.concat_tables(out) if out else _rows(0, [], [], [])


def _cut_up(b: _Block, block: int, cut: np.ndarray) -> list[pa.Table]:
    """The cells of the stretches `cut`: entries, and runs of those that the block holds earlier. Equal windows have their anchor at the same distance, so they lie in cells of the same key."""
    owner, s, n = b.owner[cut], b.start[cut], b.n[cut]
    anchor = s.copy()
    for k in np.unique(owner).tolist():
        h = _pieces(b.texts[k])
        for x in range(*np.searchsorted(owner, (k, k + 1)).tolist()):
            anchor[x] += int(np.argmin(h[s[x] : s[x] + DEPTH - PIECE + 1]))
    far, cells = (anchor - s) // CELL, (anchor - s) // CELL - (anchor - s - n + 1) // CELL + 1
    which = np.repeat(np.arange(len(cut)), cells)
    j = far[which] - (np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells))
    p = anchor[which]
    w = np.maximum(s[which], p - (j + 1) * CELL + 1)
    m = np.minimum(s[which] + n[which] - 1, p - j * CELL) - w + 1
    k, core = owner[which], p - j * CELL
    digest, texts = xxhash.xxh3_64_intdigest, [b.texts[x] for x in k.tolist()]
    key = np.fromiter((digest(x[c : c + DEPTH - CELL + 1]) for x, c in zip(texts, core.tolist(), strict=True)), np.uint64, len(k))
    content = [x[c : c + i + DEPTH - 1] for x, c, i in zip(texts, w.tolist(), m.tolist(), strict=True)]
    h = np.fromiter(map(digest, content), np.uint64, len(k))
    order = np.lexsort((h, key))
    new = np.ones(len(order), bool)
    new[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (h[order[1:]] != h[order[:-1]])  # lexsort is stable: the earliest of each content
    fresh, again = np.flatnonzero(new), np.flatnonzero(~new)
    own, at = cut[which[fresh]], w[fresh] - b.start[cut[which[fresh]]]
    return [_rows(block, k[again], w[again], m[again]), _rows(block, k[fresh], w[fresh], m[fresh], key[fresh], b.doc[own], b.at[own] + at, [content[x] for x in fresh.tolist()])]


def _spans(seen: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of seen windows within one entry; which tells the windows' entries."""
    edge = np.concatenate(([True], which[1:] != which[:-1]))
    begin = np.flatnonzero(seen & (edge | ~np.concatenate(([False], seen[:-1]))))
    return begin, np.flatnonzero(seen & (np.concatenate((edge[1:], [True])) | ~np.concatenate((seen[1:], [False]))))


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of cells that are cut: entries known by their marks, and runs, without content, of those that the batch holds earlier."""
    digest = xxhash.xxh3_128_digest
    for batch in it:
        t = pa.Table.from_batches([batch])
        t = t.take(pa.array(np.lexsort((t.column("at").to_numpy(), t.column("doc").to_numpy()))))
        k, start, n, doc, at, block = (t.column(x).to_numpy() for x in ("k", "start", "n", "doc", "at", "block"))
        mark = np.frombuffer(b"".join([digest(c[o : o + DEPTH]) for c, m in zip(t.column("content").to_pylist(), n.tolist(), strict=True) for o in range(m)]), "<u8").reshape(-1, 2)
        order = np.lexsort((mark[:, 1], mark[:, 0]))
        new = np.ones(len(order), bool)
        new[order[1:]] = (mark[order[1:]] != mark[order[:-1]]).any(axis=1)
        which, offset = np.repeat(np.arange(len(n)), n), np.arange(len(mark)) - np.repeat(np.cumsum(n) - n, n)
        fresh = np.flatnonzero(new)
        w, o = which[fresh], offset[fresh]
        ends = pa.array(np.arange(0, MARK * len(fresh) + 1, MARK, dtype=np.int32)).buffers()[1]
        content = pa.Array.from_buffers(pa.binary(), len(fresh), [None, ends, pa.py_buffer(np.ascontiguousarray(mark[fresh]))])
        begin, stop = _spans(~new, which)
        r = which[begin]
        # runs have no key to meet under: they are dealt by their places
        runs = _rows(0, k[r], start[r] + offset[begin], stop - begin + 1, (at[r] + offset[begin]) * 1_000_003 + doc[r], doc[r], at[r] + offset[begin])
        out = pa.concat_tables([_rows(0, k[w], start[w] + o, np.ones(len(w), np.int64), mark[fresh, 0], doc[w], at[w] + o, content), runs])
        out = out.set_column(0, "block", pa.array(np.concatenate((block[w], block[r]))))
        yield from out.select(batch.schema.names).combine_chunks().to_batches()


def _rows(block: int, k, start, n, key=None, doc=None, at=None, content=None) -> pa.Table:
    m = len(k)
    long = lambda x: pa.nulls(m, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64))
    return pa.table({
        "block": pa.array(np.full(m, block), pa.int64()), "k": long(k), "start": long(start), "n": long(n), "key": pa.nulls(m, pa.int64()) if key is None else _u(key), "doc": long(doc), "at": long(at),
        "content": pa.nulls(m, pa.binary()) if content is None else content if isinstance(content, pa.Array) else pa.array(content, pa.binary()),
    })


RUNS = "block long, k long, start long, n long"


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes a partition's entries through its indexes and yields the runs of windows seen earlier. Windows are equal only under the same key, so each range of keys has an index of its own, one in memory at a time."""
    t = pa.Table.from_batches(batches) if (batches := list(it)) else None
    if t is None or not t.num_rows:
        return
    del batches
    if len(told := np.flatnonzero(t.column("content").is_null().to_numpy())):
        yield from t.take(pa.array(told)).select(["block", "k", "start", "n"]).combine_chunks().to_batches()
    _, where, times = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
    t = t.take(pa.array(np.flatnonzero(t.column("content").is_valid().to_numpy() & (times[where] > 1))))
    if not t.num_rows:
        return
    t = t.take(pa.array(np.lexsort((t.column("at").to_numpy(), t.column("doc").to_numpy()))))
    key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
    marks = pc.equal(pc.binary_length(t.column("content")), MARK).to_numpy()
    shares = -(-int(n.sum()) // INDEX_WINDOWS)
    share = (key % np.uint64(shares)).astype(np.int64)
    for kind, cut in ((marks, lambda c: np.frombuffer(b"".join(c), f"S{MARK}")), (~marks, lambda c: np.concatenate([windows_of(x) for x in c]))):
        for k in range(shares):
            if len(own := np.flatnonzero(kind & (share == k))):
                yield from _through(t.take(pa.array(own)), cut)


def _through(t: pa.Table, cut) -> Iterator[pa.RecordBatch]:
    """Takes entries through an index, batch after batch in the order of places; cut gives the windows of some entries."""
    n = t.column("n").to_numpy()
    index, ends, a = LogIndex(), np.cumsum(n), 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_WINDOWS, "right")))
        part = t.slice(a, z - a)
        seen = index.add(cut(part.column("content").to_pylist()))
        # runs within each entry
        which = np.repeat(np.arange(z - a), n[a:z])
        offset = np.arange(len(which)) - np.repeat(ends[a:z] - n[a:z] - (ends[a] - n[a]), n[a:z])
        begin, stop = _spans(seen, which)
        owner = which[begin]
        take = lambda name: part.column(name).to_numpy()[owner]  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(take("block")), pa.array(take("k")), pa.array(take("start") + offset[begin]), pa.array(stop - begin + 1)], names=["block", "k", "start", "n"])
        a = z


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, th long"


def _cut(rows: pa.Table, runs: pa.Table) -> pa.Table:
    b = _Block(rows)
    k, start, n = (runs.column(x).to_numpy() for x in ("k", "start", "n"))
    order = np.lexsort((start, k))
    k, start, end = k[order], start[order], (start + n + DEPTH - 1)[order]
    lo, hi = np.searchsorted(k, np.arange(len(b.ids))), np.searchsorted(k, np.arange(len(b.ids)), "right")
    out: tuple[list, ...] = ([], [], [], [], [])
    for i, text in enumerate(b.texts):
        kept, at, spans, removed = [], 0, 0, 0
        for s, e in zip(start[lo[i] : hi[i]].tolist(), end[lo[i] : hi[i]].tolist(), strict=True):
            if s > at or not spans:
                kept.append(text[at:s])
                spans += 1
                removed += e - s
                at = e
            elif e > at:
                removed += e - at
                at = e
        kept.append(text[at:])
        left = b"".join(kept)
        for column, x in zip(out, (len(text), removed, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
            column.append(x)
    return pa.table({"doc_id": b.rows.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string()), "kept": pa.array(out[4], pa.binary()), "th": _u(np.array([xxhash.xxh64_intdigest(t, 42) for t in b.texts], np.uint64))})


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay), th (xxhash64 of the text).

    Null text is empty; texts under DEPTH bytes lose nothing. Rows that repeat a doc_id count as documents
    that follow each other, in the order of their texts; rows without a doc_id come last of all. An empty
    table gives an empty result. Hashes with more than hot different stretches are cut into cells, cells with more
    than hot contents into windows known by their fingerprints; what is removed is the same for any hot.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(blocks, "block")
    said = docs.groupBy("block").applyInArrow(_say, SAID)
    told = written(said.repartition(blocks, "a").mapInArrow(_tell(hot), TOLD), "told")
    free(spark)
    at_block = told.repartition(blocks, "block").groupBy("block")
    found = written(docs.groupBy("block").cogroup(at_block).applyInArrow(_find, FOUND), "found")
    free(spark)
    entries = found.where("content is not null")
    cut = written(entries.groupBy("key").agg(F.count("*").alias("contents")).where(F.col("contents") > hot).select("key"), "cut")
    if not cut.isEmpty():
        cut = F.broadcast(cut) if small_enough(cut, MOST_CUT) else cut
        entries = entries.join(cut, "key", "left_anti").unionByName(entries.join(cut, "key", "left_semi").select(*found.columns).mapInArrow(_windows, FOUND))
    entries = entries.select(*found.columns).repartition(blocks, "key")
    scanned = written(entries.mapInArrow(_scan, RUNS), "scanned")
    free(spark)
    runs = found.where("content is null").select("block", "k", "start", "n").unionByName(scanned)
    return docs.groupBy("block").cogroup(runs.repartition(blocks, "block").groupBy("block")).applyInArrow(_cut, KEPT)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept", "th")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text NULLS FIRST) AS k, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT k, p, substr(x, 2 * p + 1, {2 * DEPTH}) AS s FROM (SELECT k, x, unnest(range(n - {DEPTH - 1})) AS p FROM d)),
r AS (SELECT k, p FROM (SELECT k, p, row_number() OVER (PARTITION BY s ORDER BY k, p) AS nth FROM w) WHERE nth > 1),
e AS (SELECT k, p, sum(fresh) OVER (PARTITION BY k ORDER BY p) AS span FROM (SELECT k, p, (p > coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -{2 * DEPTH}) + {DEPTH})::INT AS fresh FROM r)),
s AS (SELECT k, span, min(p) AS a, max(p) + {DEPTH} AS z FROM e GROUP BY ALL),
g AS (SELECT k, span, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY span), 0) AS was FROM s),
c AS (SELECT k, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY span) AS kept FROM g JOIN d USING (k) GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN c USING (k)
"""


@carried()
def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of their texts (characters that a cut splits go too, n_chars follows); documents of which no word is left go."""
    # rows alike in doc_id and text have a cut each: they are dealt one by one
    cut = deduplicated(docs).where("n_removed > 0").withColumn("c_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "th"))
    cut = cut.groupBy("c_key").agg(F.sort_array(F.collect_list(F.struct("n_removed", "kept")), asc=False).alias("c_cuts"))
    rows = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "_th"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*[n for n in ROW if n in docs.columns and n != "text"])))
    joined = rows.join(cut, rows["_key"] == cut.c_key, "left").withColumn("c_kept", F.get("c_cuts", F.col("_n") - 1)["kept"])
    changed = F.col("c_kept").isNotNull()
    text = F.regexp_replace(F.make_valid_utf8(F.col("c_kept").cast("string")), "\ufffd", "")
    joined = joined.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
