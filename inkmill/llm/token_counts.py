"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Each task turns its texts into pre-token frequencies. Pre-tokens that are entries of the tokenizer's own
vocabulary (fixed size, about 50,000) are known to every worker; all others travel, with the documents
that hold them as postings, to the partition of their hash, where they stand sorted: each distinct one
is given to the library once, and its count is multiplied into its postings. Sums by document follow.
No token id is kept anywhere.
"""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import only, table

LIMIT, TOKENIZER = 512, "byte_bpe_50k.json"
#: Postings that a task holds before it passes them on.
HELD = 1_500_000
#: The published split pattern of byte-level BPE (fixed value).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose classes are settled in all Unicode versions in use; a text with others is split by the library itself.
UNSETTLED = re.compile("[^\x00-ԯ -⁯₠-⃀　-〿ぁ-ゖァ-ヺ㐀-䶿一-鿿가-힣！-｠\U0001f300-\U0001f64f]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _loaded(path: str):
    """(tokenizer, pre-tokenizer, special strings' pattern or None, vocabulary entries as strings with their counts)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    words = t.get_vocab(with_added_tokens=False)
    bytes_of = decoders.ByteLevel()
    known = {s for w in words if "�" not in (s := bytes_of.decode([w]))}
    known = sorted(known - set(special))
    counts = {k: len(e) for k, e in zip(known, t.encode_batch_fast(known, add_special_tokens=False), strict=True)}
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    return t, t.pre_tokenizer, pattern, counts


def frequencies(text: str, path: str) -> tuple[int, Counter]:
    """How many special strings the text holds, and its pre-tokens' frequencies."""
    _, pre, special, _ = _loaded(path)
    parts, n = [text], 0
    if special and special.search(text):
        pieces = special.split(text)
        parts, n = pieces[::2], len(pieces) // 2
    found: Counter = Counter()
    for part in parts:
        if UNSETTLED.search(part):
            found.update(part[a:b] for _, (a, b) in pre.pre_tokenize_str(part))
        else:
            found.update(SPLIT.findall(part))
    return n, found


def _postings(path: str):
    schema = pa.schema([("pre", pa.string()), ("uid", pa.list_(pa.int64())), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(path)[3]
        held: dict[str, list[int]] = defaultdict(list)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            # in order, so that neighbours share beginnings and compress
            items = sorted(held.items())
            for a in range(0, len(items), 50_000):
                part = items[a : a + 50_000]
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v for _, v in part], pa.list_(pa.int64())), none, none, none], schema=schema)
            held.clear()

        for batch in it:
            base = ([], [], [], [])
            for uid, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sure, found = frequencies(text or "", path)
                for k, n in found.items():
                    c = known.get(k)
                    if c is None:
                        # most occur once in a text: repeats of the id take less than a count beside each
                        held[k] += [uid] * n if n > 1 else (uid,)
                        size += n
                    else:
                        sure += c * n
                for column, x in zip(base, (uid, sure, doc_id, len((text or "").encode())), strict=True):
                    column.append(x)
                if size >= HELD:
                    yield from out()
                    size = 0
            uids, ns, ids, lengths = base
            one = pa.array(range(len(uids) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(uids), pa.string()), pa.ListArray.from_arrays(one, pa.array(uids, pa.int64())), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())], schema=schema)
        yield from out()

    return run


def _resolve(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(path)[0]
        last, last_count = None, 0
        for batch in it:
            pre, uid, n, doc_id, n_bytes = batch.columns
            base = pre.is_null()
            # base rows already have their count; the others stand sorted, so equal ones are adjacent
            pres = pre.to_pylist()
            new = [p for i, p in enumerate(pres) if p is not None and p != (pres[i - 1] if i else last)]
            counts = iter([len(e) for e in t.encode_batch_fast(new, add_special_tokens=False)]) if new else iter(())
            factor = np.ones(len(pres), np.int64)
            for i, p in enumerate(pres):
                if p is None:
                    continue
                if p != (pres[i - 1] if i else last):
                    last_count = next(counts)
                factor[i] = last_count
            last = pres[-1] if pres else last
            rest = batch.filter(pa.compute.invert(base))
            lengths = np.diff(rest.column(1).offsets.to_numpy())
            uids = rest.column(1).flatten().to_numpy()
            sums = np.repeat(factor[~base.to_numpy(zero_copy_only=False)], lengths)
            ids, at = np.unique(uids, return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, at, sums)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total), none, none], names=["uid", "n", "doc_id", "n_bytes"])
            first = batch.filter(base)
            yield pa.RecordBatch.from_arrays([first.column(1).flatten(), first.column(2), first.column(3), first.column(4)], names=["uid", "n", "doc_id", "n_bytes"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs(doc_id, text), a table that reads in the same order again.

    Counts are those of the library with add_special_tokens=False: its special strings inside texts count
    as it counts them, one token each. Null and empty texts have 0. Repeated rows stay rows of their own,
    and an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    sent = rows.mapInArrow(_postings(path), "pre string, uid array<long>, n long, doc_id long, n_bytes long")
    sent = sent.withColumn("salt", F.when(F.col("pre").isNull(), F.get("uid", F.lit(0)))).repartition("pre", "salt").drop("salt").sortWithinPartitions("pre")
    parts = sent.mapInArrow(_resolve(path), "uid long, n long, doc_id long, n_bytes long")
    sums = parts.groupBy("uid").agg(F.sum("n").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    return sums.select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
