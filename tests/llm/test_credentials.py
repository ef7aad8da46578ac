import hashlib
import random
import re

from pyspark.sql import functions as F

from inkmill.llm import credentials

DOC = "doc_id long, text string, source string, lang string, u int, c string, hash string, owners int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX, RUN = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile("[A-Za-z0-9_-]{20,}")
BAD = re.compile("example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef(g|$)", re.I)


def base(t):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(t) if len(m[0]) >= 32]


def live(v):
    return len(set(v)) >= 6 and not BAD.search(v)


def brute(rows):
    found = []
    for _, t, _, _ in rows:
        own = base(t or "")
        runs = [(m.start(), 3, m.end(), m[0]) for m in RUN.finditer(t or "")]
        runs = [r for r in runs if re.search("[0-9]", r[3]) and re.search("[A-Z]", r[3]) and re.search("[a-z]", r[3]) and len(set(r[3])) >= 12 and live(r[3])]
        found.append(sorted(own) + [r for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in own)])
    owners, repos = {}, {}
    for (_, _, s, lang), spans in zip(rows, found, strict=True):
        for x in spans:
            owners.setdefault(x[3], set()).add(s)
            repos.setdefault(x[3], set()).add((s, lang))
    copied = lambda v: len(owners[v]) > 2 or len(repos[v]) > 4
    out = []
    for (i, *_), spans in zip(rows, found, strict=True):
        kept = sorted(x for x in spans if x[1] < 3 or not copied(x[3]))
        say = lambda xs: ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{a}:{b}" for a, k, b, _ in xs)
        n = [sum(x[1] == k for x in kept) for k in range(4)]
        out.append((i, *n[:3], hashlib.sha256(say([x for x in kept if x[1] < 3]).encode()).hexdigest(), say(kept), n[3], sum(live(x[3]) and not copied(x[3]) for x in kept), sum(copied(x[3]) for x in kept)))
    return sorted(map(repr, out))


def given():
    rng = random.Random(5)
    key = lambda n, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789": "".join(rng.choice(a) for _ in range(n))
    shared, example, hexed = key(24), "AKIA" + key(16, "ABCDEFG234567"), key(40, "0123456789abcdef")
    parts = [
        lambda: f'token = "{key(40, "0123456789abcdef")}"', lambda: f"PassWord:{key(12)}", lambda: f"api_key='{key(9)}'", lambda: f"APIKEY == {key(30)}", lambda: "secret: token: abcdefghijk", lambda: "token=short", lambda: f"ſecret={key(9)}",
        lambda: f"AKIA{key(16, 'ABCDEF0123')}", lambda: "AKIAAKIA12", lambda: f"AKIA{key(40, 'ABC1')}", lambda: key(32, "abc012"), lambda: key(31, "abc012"), lambda: key(24), lambda: f"ghp_{key(36)}", lambda: "aB3example" + key(20), lambda: shared, lambda: example, lambda: hexed,
        lambda: "word " * rng.randint(1, 5), lambda: "ünï\U0001f600 ", lambda: f"my_secret_token={key(24)}", lambda: f"x{key(22)}token={key(10)}", lambda: "\n",
    ]
    rows = []
    for k in range(260):
        text = "".join(rng.choice(parts)() + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice([None, k]), text, rng.choice([None, "", "a", "b", "c"]), rng.choice([None, "en", "de", "fr"])))
    own = key(28)
    rows += [(None, None, None, None), (1, "", "a", "en"), (2, " ".join(parts[0]() + " " + key(25) for _ in range(1500)), "a", "en")]
    rows += [(3, f"key {own} here", "a", "en")] * 50 + [(4, f"{own}", "b", None)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    """Overlaps, failing matches, wide characters, nulls as owners, a hot value, rows alike, a text of many matches, columns that clash."""
    rows = given()
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOC).repartition(3)
    monkeypatch.setattr(credentials, "table", lambda *_: docs)
    want = brute(rows)
    assert sum("owned:" in x for x in want) > 50
    for hot in (1000, 3):
        monkeypatch.setattr(credentials, "HOT", hot)
        got = credentials.op13_secret_scans(spark, "")
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_running_results(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1, 1001)),)], "a array<int>")
    got = df.select(credentials.scanned("a", lambda x, y: x + y).alias("s")).collect()
    assert [r.s for r in got] == [[], [5], [k * (k + 1) // 2 for k in range(1, 1001)]]


def test_owners_count_pairs_once(spark):
    rows = [("h", None, None), ("h", None, "r"), ("h", None, "r"), ("h", "a", None), ("g", "a", "r")]
    got = credentials.owners(spark.createDataFrame(rows, "hash string, owner string, repo string")).collect()
    assert sorted(map(tuple, got)) == [("g", 1, 1, 1), ("h", 4, 2, 3)]


def test_scan_gives_spans(spark):
    docs = spark.createDataFrame([(7, "é token=abcd1234", "me", "en", 1, "x", "y", 2)], DOC)
    (row,) = credentials.scan(docs, F.col("source"), F.col("lang")).collect()
    (s,) = row.spans
    assert (row.doc_id, s.start, s.kind, s.end, s.owners, s.repos, s.copied) == (7, 2, 0, 16, 1, 1, False)
    assert s.hash == hashlib.sha256(b"abcd1234").hexdigest()[:32]


def test_empty(spark):
    assert credentials.scan(spark.createDataFrame([], DOC), F.col("source"), F.col("lang")).collect() == []
