import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkmill.llm import lexical

DOC = "doc_id long, text string, u int, item_id int, score string, n int"
ITEM = "item_id long, text string, doc_id int, u string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, top, once=True):
    have = [(d, Counter(terms(t))) for d, t in docs]
    have = [(d, c) for d, c in have if c]
    n_docs, n_terms, df = len(have), sum(sum(c.values()) for _, c in have), Counter(t for _, c in have for t in c)
    out = []
    for item, t in items:
        q, found = Counter(terms(t)), []
        for d, c in have:
            n, score = sum(c.values()), 0
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            for x, k in q.items():
                if x in c:
                    score += (1 if once else k) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(map(repr, out))


def given(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "éa", "É", "x1", "x_1", "a-b", "ſ", "日本", "\x7f", "\x00z"] + [f"w{k}" for k in range(60)]
    text = lambda k: " ".join(rng.choice(words) if rng.random() < 0.7 else "the" for _ in range(rng.randint(1, k)))
    docs = [(k, text(80)) for k in range(n)] + [(None, text(9)), (None, None), (n, ""), (n + 1, " .,\n"), (n + 2, "w1 " * 20_000)]
    docs += [docs[3]] * 60 + [(1000 + k, docs[5][1]) for k in range(70)]
    items = [(k, text(12)) for k in range(15)] + [(3, "w1 w2 w1"), (None, "the w3"), (90, None), (91, "..."), (92, "unseen"), (93, "the"), (94, docs[5][1])]
    return docs, items


@pytest.mark.parametrize(("top", "once", "entries", "parts"), [(50, True, 500_000, 1), (7, True, 40, 9), (50, False, 500_000, 3)])
def test_against_brute_force(spark, monkeypatch, top, once, entries, parts):
    """Ties, nulls, repeated rows and ids, common terms, a long text, blocks of items and of documents, columns that clash."""
    monkeypatch.setattr(lexical, "ITEM_ENTRIES", entries)
    if parts > 1:
        monkeypatch.setattr(lexical, "DOC_ENTRIES", 300)
    docs, items = given(top)
    d = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in docs], DOC).repartition(parts)
    q = spark.createDataFrame([(*r, 1, "x") for r in items], ITEM)
    got = lexical.search(d, q, top, once)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(docs, items, top, once)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_terms():
    for t in ("Don't STOP_now é\x7fÉ 日本、x", "", None, "a\x00b\x1fc\x80d"):
        assert [x.decode() for x in lexical.terms(t and t.encode())] == terms(t)


def test_lengths_beyond_64_bits():
    assert lexical.length_part(np.array([10**7, 3]), 10**12, 10**14).tolist() == [50 + 50 * 10**19 // 10**14, 50 + 150 * 10**12 // 10**14]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", 1, "x")], ITEM)
    assert lexical.search(none, one).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a", 1, 2, "x", 3)], DOC), one.limit(0)).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None, 1, 2, "x", 3)], DOC), one).collect() == []
