import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkmill.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, g string, rank long, n int, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, s, lang, n, t):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)])


def tree(nodes):
    """All levels, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha(*x[a : a + 3]) for a in range(0, len(x), 3)])
    return levels


def brute(rows):
    by = {}
    for i, t, lang, s, n in rows:
        bad = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by.setdefault(s, []).append((i is not None, i or 0, leaf(i, s, lang, n, t), leaf(i, s, lang, n, bad), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s])]) for s in names]
    over = tree([t[-1][0] for t in trees])
    root, out = over[-1][0], []
    for k, s in enumerate(names):
        for at, (_, _, a, b, i) in enumerate(sorted(by[s])):
            now, proof = b, []
            for levels, p in ((trees[k], at), (over, k)):
                for x in levels[:-1]:
                    lo = p - p % 3
                    l, r = x[lo:p], x[p + 1 : lo + 3]
                    proof += l + r
                    now = sha(*l, now, *r)
                    p //= 3
            out.append((i, a, trees[k][-1][0], root, sha(*proof), now, now == root))
    return sorted(map(repr, out))


def given(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(1900):  # one source spans several blocks
        rows.append((k * rng.choice([1, 1, -7, 1 << 40]), f"t{k}\nü" * rng.randint(0, 3), "en", "hot", k))
    for k in range(300):
        s = rng.choice([None, "", "a", "bé", "same-long-prefix-1", "same-long-prefix-2", "\U0001f600", "￮"])
        rows.append((rng.choice([None, 7, k, -(1 << 63)]), rng.choice([None, "", "x\ny", f"z{k}\n"]), rng.choice([None, "de"]), s, rng.choice([None, k])))
    rows += [rows[5]] * 40 + [(None, "one\ntext", None, "hot", None)] * 30
    rows += [(1, "lone\n", "en", "lone", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [4096, 8])
def test_against_brute_force(spark, monkeypatch, chunk):
    """Ties of ids, rows alike in all, null ids, names and texts, a source of one row, columns that clash."""
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = given(chunk)
    # of the null and the least id, only one is given a place first by definition
    rows = [r for r in rows if r[0] != -(1 << 63)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC).repartition(5)
    got = merkle.verified(docs, merkle.tampered()).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute([(i, t, lang, s, n) for i, t, lang, s, n in rows])
    assert {r.verified for r in got} == {True, False}


def test_null_and_least_ids_share_a_place(spark):
    rows = [(i, f"t{k}", "en", "s", k) for k, i in enumerate([None, -(1 << 63), None, -(1 << 63), 0])]
    got = merkle.manifest(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC)).orderBy("rank").collect()
    first = [bytes(r.leaf).hex() for r in got[:4]]
    assert first == sorted(first) and got[4].doc_id == 0


def test_ranks_of_far_apart_keys(spark):
    rng = random.Random(4)
    keys = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(400)] + [k << s for k in range(9) for s in (0, 7, 8, 21, 22, 36, 50, 59)]
    rows = [(f"g{k % 3}", v) for k, v in enumerate(keys)]
    got = merkle.ranked(spark.createDataFrame(rows, "g string, v long"), ["v"], lambda j: F.col("v") if j == 0 else None).collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted(v for x, v in rows if x == g)
        assert sorted((r["rank"], r.v, r.copies, r.n) for r in got if r.g == g) == sorted({(mine.index(v), v, mine.count(v), len(mine)) for v in mine})


def test_proofs_lead_to_the_root(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 4}", k) for k in range(50)]
    got = merkle.manifest(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC)).collect()
    assert len({bytes(r.root) for r in got}) == 1 and sorted((r.source, r["rank"]) for r in got) == sorted((f"s{k % 4}", k // 4) for k in range(50))
    assert all(merkle.fold(bytes(r.leaf).hex(), bytes(r.proof)) == bytes(r.root).hex() for r in got)
    assert merkle.fold(bytes(got[0].leaf).hex(), bytes(got[1].proof)) != bytes(got[0].root).hex()


def test_empty(spark):
    got = merkle.verified(spark.createDataFrame([], DOC), merkle.tampered())
    assert got.collect() == [] and got.columns == merkle.OUT
