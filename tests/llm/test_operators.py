import collections
import hashlib
import html as H
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inkmill.llm import decontam, html_main, license, lm, mixing, near, quality, simhash, suffix, token_counts, warc

DOC = "doc_id long, text string, lang string, source string, clash int, fp int, w int"
W = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ß"[:7]) for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = [None, "", " \n ", "a", "a b", "Same words here again", "Same words here again", "z" * 5000, "ab " * 300, "don't STOP  now\n\n <|endoftext|> 12 ok"]
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        if rng.random() < 0.4:
            words.insert(rng.randrange(len(words)), passage)
        out.append(" ".join(words) if rng.random() < 0.5 else "\n".join(words))
    return out + [out[-1], out[-1] + " more"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 11 == 0 else "en" if i % 2 else "fr", None if i % 7 == 0 else f"s{i % 3}", 1, 2, 3) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOC)


def got(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_covering_masks_lose_no_pair():
    masks, rng = simhash.covering_masks(), random.Random(3)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not bits & m for m in masks)


def test_simhash(spark, docs):
    want = {}
    for i, t in enumerate(texts()):
        w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        want[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    component = {i: i for i in want}
    for _ in want:
        for a in want:
            for b in want:
                if (want[a] ^ want[b]).bit_count() <= 3:
                    component[a] = component[b] = min(component[a], component[b])
        if all(component[component[i]] == component[i] for i in want):
            break
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id")
    assert got(found, "doc_id", "f", "component_id") == {i: (f"{want[i]:016x}", component[i]) for i in want}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def cut_by_force(every):
    seen, want = set(), {}
    for i, t in enumerate(every):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return want


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix(spark, docs):
    want = cut_by_force(texts())
    assert got(suffix.deduplicated(docs), *SUFFIX) == want
    assert sum(x[1] for x in want.values()) > 0
    for hot in (0, 10**6):
        assert got(suffix.deduplicated(docs, hot), *SUFFIX) == want
    assert suffix.deduplicated(empty(spark)).count() == 0


def test_suffix_with_a_passage_in_more_documents_than_hot(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    every = ["".join(rng.choice("ijklm ") for _ in range(60)) + passage + "".join(rng.choice("nopq ") for _ in range(60)) for _ in range(suffix.HOT + 60)]
    assert got(suffix.deduplicated(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")), *SUFFIX) == cut_by_force(every)


def test_cut_stretches_cost_few_rows():
    """A hash with too many stretches costs some cells a stretch, not a row for each window."""
    rng = random.Random(6)
    text = bytes(rng.randrange(32, 127) for _ in range(4000))
    a, _, n = suffix.stretches(text)
    rows = pa.table({"block": [0], "doc_id": [1], "text": [text.decode()]})
    told = pa.table({"block": [0] * len(a), "a": a.view("int64"), "kind": [suffix.CUT] * len(a)})
    found = suffix._find(rows, told)
    assert sum(found.column("n").to_pylist()) == n.sum() == 3901
    assert found.num_rows < n.sum() / 5 and sum(map(len, found.column("content").to_pylist())) < 12 * len(text)


def test_index_shares_lose_no_match(monkeypatch):
    rng = random.Random(8)
    base = {k: bytes(rng.randrange(32, 127) for _ in range(160)) for k in range(30)}
    rows = []
    for i in range(400):
        key = rng.randrange(30)
        if key % 3 == 0:
            rows.append((0, i, 0, 1, key, i, 0, bytes([key, rng.randrange(4)]) + bytes(14)))
        else:
            at = rng.randrange(40)
            rows.append((0, i, 0, 21, key, i, 0, base[key][at : at + 120]))
    rng.shuffle(rows)
    names = ["block", "k", "start", "n", "key", "doc", "at", "content"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(x, pa.int64()) for x in names[:-1]] + [("content", pa.binary())]))
    seen, want = set(), set()
    for _, k, _, n, key, _, _, content in sorted(rows, key=lambda r: r[5]):
        for w in range(n):
            window = (key, content[w : w + 100])
            if window in seen:
                want.add((k, w))
            seen.add(window)
    for windows in (10**6, 700):
        monkeypatch.setattr(suffix, "INDEX_WINDOWS", windows)
        found = [r for b in suffix._scan(iter([batch])) for r in b.to_pylist()]
        assert {(r["k"], r["start"] + j) for r in found for j in range(r["n"])} == want
    assert list(suffix._scan(iter([batch.slice(0, 0)]))) == [] and list(suffix._scan(iter([]))) == []


def test_log_index_levels_shrink():
    index, seen, rng = suffix.LogIndex(), set(), random.Random(2)
    for _ in range(40):
        batch = [f"{rng.randrange(500):03d}".encode() for _ in range(20)]
        out = index.add(np.array(batch, "S100"))
        for x, y in zip(batch, out, strict=True):
            assert y == (x in seen)
            seen.add(x)
        sizes = [len(x) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path())
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x in enumerate(texts())}
    assert got(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_settled_characters_are_split_alike():
    from tokenizers import pre_tokenizers

    pre = pre_tokenizers.ByteLevel(add_prefix_space=False)
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not token_counts.UNSETTLED.search(chr(c))]
    for a in range(0, len(chars), 500):
        s = "".join(f"a1!{c}a1!  {c}{c} " for c in chars[a : a + 500])
        assert [s[x:y] for _, (x, y) in pre.pre_tokenize_str(s)] == token_counts.SPLIT.findall(s)


def test_quality(spark, docs):
    want = {}
    for i, t in enumerate(texts()):
        w = W.findall(t or "")
        grams = collections.defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        rep = {k + j for v in grams.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
    found = quality.judged(docs)
    assert got(found, "doc_id", *quality.COUNTS, "base_failed") == want
    assert all(not k or not b for b, k in got(found, "doc_id", "base_failed", "kept").values())
    assert quality.judged(empty(spark)).count() == 0


def test_fences_are_those_of_exact_quantiles(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60 + i % 40)]
        junk = rng.random()
        for _ in range(int(rng.random() * 20) if junk < 0.3 else 0):
            words[rng.randrange(len(words))] += rng.choice("#%&")
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = rng.choice(["Abc", "XYZ"])
        rows.append((i % 390 if i % 7 else None, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])))
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_words int, fence int")
    found = [r.asDict() for r in quality.judged(d).collect()]
    passed = [r for r in found if not r["base_failed"]]

    def quantile(of, name, level):
        values = sorted(r[name] for r in of)
        return values[max(0, -(-level * len(values) // 1000) - 1)] if values else 0.0

    fences = set()
    for r in found:
        ok = not r["base_failed"]
        for name, (part, whole, level) in quality.RATES.items():
            fence, n = 0.0, quality.SHRINK
            fence = quantile(passed, name, level)
            for of in ([x for x in passed if x["lang"] == r["lang"]], [x for x in passed if (x["lang"], x["source"]) == (r["lang"], r["source"])]):
                fence = (len(of) * quantile(of, name, level) + n * fence) / (len(of) + n)
            fence *= quality.STRETCH
            assert fence - 1e-9 <= r[f"{name}_fence"] <= fence * quality.GAMMA + 1e-9  # the sketch's error
            fences.add((name, round(r[f"{name}_fence"], 9)))
            ok = ok and r[part] - quality.ERRORS * r[part] ** 0.5 <= r[f"{name}_fence"] * r[whole] + 1e-9
        assert r["kept"] == ok
    assert len(found) == 400 and len(fences) > 15 and 0 < sum(r["kept"] for r in found) < len(passed)
    assert quality.keep_good(d).columns == d.columns and quality.keep_good(d).count() == sum(r["kept"] for r in found)
    assert all(r[f"{name}_fence"] > 0 for r in found for name in quality.RATES)


def test_each_rate_rejects_its_own_junk(spark):
    """Junk of four kinds, each rejected by one fence; long texts with a few symbols, capitals and repeated lines stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    lines = lambda w, k: "\n".join(" ".join(w[a : a + k]) for a in range(0, len(w), k))
    rows = [(i, lines(prose(80 + i % 300), 20), rng.choice(["en", "fr"]), rng.choice(["a", "b"])) for i in range(800)]
    few = prose(5000)
    for k in range(5):
        few[100 * k] += "&"
        few[7 + 100 * k] = few[7 + 100 * k].upper()
    rows.append((900, lines(few, 20) + "\nsame line\nother\nsame line", "en", "a"))
    dup = [" ".join(prose(12)) for _ in range(8)]
    junk = {
        "symbol_rate": lines([w + "%#" for w in prose(100)], 20),
        "dup_line_rate": "\n".join(x for w in prose(80) for x in (w, "first", "second")),
        "repeat_rate": " ".join([*prose(70), *dup[0].split(), *prose(3), *dup[0].split(), *prose(3), *dup[0].split()]),
        "upper_rate": lines([w.upper() if k % 2 else w for k, w in enumerate(prose(120))], 20),
    }
    rows += [(1000 + k, t, "en", "a") for k, t in enumerate(junk.values())]
    found = {r.doc_id: r.asDict() for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    over = {i: [name for name, (part, whole, _) in quality.RATES.items() if r[part] - quality.ERRORS * r[part] ** 0.5 > r[f"{name}_fence"] * r[whole] + 1e-9] for i, r in found.items()}
    assert [over[1000 + k] for k in range(4)] == [[name] for name in junk] and not any(found[1000 + k]["base_failed"] for k in range(4))
    assert not any(found[1000 + k]["kept"] for k in range(4)) and all(found[i]["kept"] for i in [*range(800), 900])
    assert len({r["symbol_rate_fence"] for r in found.values()}) == 4


def test_mixing(spark, docs):
    size = {i: len(W.findall(t or "")) for i, t in enumerate(texts())}
    source = {i: None if i % 7 == 0 else f"s{i % 3}" for i in size}
    total = collections.Counter()
    for i in size:
        total[source[i]] += size[i]
    names = ["s0", "s1", "s2", None]
    weight, most, left = dict(zip(names, (5, 2, 1, 5), strict=True)), {s: 2 * total[s] for s in names}, 1.5 * sum(size.values())
    target, free = {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if most[s] < level * weight[s]}
        for s in full or free:
            target[s] = most[s] if full else level * weight[s]
        left -= sum(most[s] for s in full)
        free = free - full if full else set()
    found = got(mixing.mixed(docs), "doc_id", "size", "source_size", "target", "taken", "position")
    taken = collections.Counter()
    for i, (n, whole, goal, took, _) in found.items():
        assert (n, whole) == (size[i], total[source[i]]) and goal == pytest.approx(target[source[i]]) and 0 <= took <= 2 * n
        taken[source[i]] += took
    assert len(found) == len(size) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert found == got(mixing.mixed(docs.repartition(3)), "doc_id", "size", "source_size", "target", "taken", "position")
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixing_of_rows_that_share_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, i]), " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "ß", None])) for i in range(120)] + [(5, "one and the same", "a")] * 60
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"order": F.lit("clash"), "th": F.lit(1), "copies": F.lit(2), "target": F.lit(3)})
    names = ("doc_id", "size", "source_size", "target", "taken", "positions")
    held = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    found = held(mixing.mixed(d))
    assert len(found) == 180 and found == held(mixing.mixed(d.repartition(7)))
    goal = {(x[2], round(x[3], 6)) for x in found}
    assert sum(x[4] for x in found) == sum(round(t) for _, t in goal)


def test_every_pass_of_the_mix_has_a_position(spark, docs):
    found = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert max(len(r.positions) for r in found.values()) > 1
    order = [r.asDict() for r in mixing.in_order(docs).collect()]
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert collections.Counter(r["doc_id"] for r in order) == {i: len(r.positions) for i, r in found.items() if r.taken}
    words = collections.Counter()
    for r in order:
        words[r["doc_id"]] += r["taken"]
    assert words == {i: r.taken for i, r in found.items() if r.taken}
    names = ["s0", "s1", "s2", None]
    for k, s in enumerate(names):
        tilt, at, mine = mixing.TILTS[k % 3], 0, [r for r in order if source[r["doc_id"]] == s]
        goal = round(found[mine[0]["doc_id"]].target)
        for r in sorted(mine, key=lambda r: (r["pass"], r["position"])):  # the words taken before a row are the demand at its position
            t = r["position"]
            assert (1 - tilt) * t + tilt * t * t == pytest.approx(at / goal, abs=1e-9)
            at += r["taken"]
        assert at == goal


@pytest.mark.parametrize("least", [1, 2, 4])
def test_scores(spark, docs, least):
    import math

    counts, all_words = collections.Counter(), [[w for w in (t or "").encode().lower().split()] for t in texts()]
    for w in all_words:
        for k in (1, 2, 3):
            counts.update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    n = sum(map(len, all_words))
    want = {}
    for i, w in enumerate(all_words):
        score = 0.0
        for a in range(len(w)):
            factor = 1.0
            for k in range(min(2, a), -1, -1):
                gram = tuple(w[a - k : a + 1])
                if k == 0 or counts[gram] >= least:
                    score += math.log(factor * counts[gram] / (counts[gram[:-1]] if k else n))
                    break
                factor *= 0.4
        want[i] = (len(w), pytest.approx(score, abs=1e-4))
    assert got(lm.scored(docs, least=least), "doc_id", "n_tokens", "log_score") == want
    assert lm.scored(empty(spark)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50))), "x") for k in range(20)] + [(98, "two words", "x"), (99, None, "x")]
    rows = []
    for i in range(80):
        t = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        item = items[rng.randrange(20)][1].split()
        if i % 3 == 0:
            for _ in range(i % 4):
                item[rng.randrange(len(item))] = "changed"
            t[len(t) // 2 : len(t) // 2] = item
        rows.append((i, " ".join(t) if i != 7 else None, 0))
    rows.append((100, "Two, words!", 0))
    for i in range(200, 230):  # rotated, and with halves apart
        item = items[i % 20][1].split()
        at = rng.randrange(len(item))
        item = item[at:] + [rng.choice(words)] * (i % 3 - 1) + item[:at]
        rows.append((i, " ".join([rng.choice(words) for _ in range(rng.randint(0, 40))] + item + [rng.choice(words) for _ in range(rng.randint(0, 40))]), 0))

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []

    want = {}
    for i, t, _ in rows:
        hits = set()
        for k, x, _ in items:
            a, b = shingles(t), shingles(x)
            for s in range(max(1, len(a) - len(b) + 1)) if b else ():
                part = a[s : s + len(b)]
                both = sum((collections.Counter(part) & collections.Counter(b)).values())
                if both and both / (len(part) + len(b) - both) >= 0.8:
                    hits.add(k)
        want[i] = (sorted(hits),)
    d, b = spark.createDataFrame(rows, "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    assert got(decontam.decontaminated(d, b), "doc_id", "item_ids") == want
    assert sum(bool(x[0]) for x in want.values()) > 5 and want[100] == ([98],) and sum(bool(want[i][0]) for i in range(200, 230)) > 10
    assert decontam.decontaminated(d.limit(0), b).count() == 0
    assert not any(x[0] for x in got(decontam.decontaminated(d, b.limit(0)), "doc_id", "contaminated").values())


def test_decontamination_by_every_benchmark_row(spark):
    t = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    b = spark.createDataFrame([(1, t[0]), (1, t[1]), (1, t[1]), (None, t[2]), (2, None), (None, None), (3, t[1])], "item_id long, text string")
    d = spark.createDataFrame([(k, f"x y {x} z") for k, x in enumerate(t)] + [(9, " ".join(t[:3]))], "doc_id long, text string")
    found = got(decontam.decontaminated(d, b), "doc_id", "contaminated", "n_items", "item_ids")
    assert found == {0: (True, 1, [1]), 1: (True, 2, [1, 3]), 2: (True, 1, []), 3: (False, 0, []), 9: (True, 3, [1, 3])}
    assert [r.doc_id for r in decontam.without_leaks(d, b).collect()] == [3]


def test_licences_and_inheritance(spark):
    full = lambda name: f"Copyright (c) 2020 Some Body\n\n{license.TEXTS[name]}\n"
    rows = [
        (1, "a/LICENSE", full("Apache-2.0")), (2, "a/b/x", "words\nmore"), (3, "a/b/LICENSE", full("MIT")), (4, "a/b/c/y", None), (5, "z", "text about the of in"),
        (6, "a/b/w", "code\nLicensed under CC BY-NC 4.0.\ncode code"), (7, None, ""), (8, "s/main.c", "// SPDX-License-Identifier: MIT\nint x;"), (9, "s/other.c", "int y;"), (10, "t/terms.txt", full("BSD-3-Clause")),
        (11, "t/u/v/x", "words"), (12, "n/COPYING.md", "Some notes. Released under the MIT License. More notes follow here."), (13, "n/x", ""), (14, "o/notes", "Released under the MIT License."), (15, "o/x", "words"),
        (16, "p/x.py", "# " + license.NOTICES["Apache-2.0"][2].replace("\n", "\n# ") + "\n\nimport os\n"), (17, "a/b/c/y", "words"), (None, "a/q", "words"), (18, "s/z", "SPDX-License-Identifier: Unheard-Of"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("kind", F.lit(1))
    found = got(license.licensed(d), "doc_id", "own_license", "own_kind", "inherited_license", "inherited_from")
    none = (None,) * 4
    assert found == {
        1: ("Apache-2.0", "file", None, None), 2: (None, None, "MIT", "a/b"), 3: ("MIT", "file", None, None), 4: (None, None, "MIT", "a/b"), 5: none, 6: ("CC-BY-NC-4.0", "header", None, None), 7: none,
        8: ("MIT", "header", None, None), 9: none, 10: ("BSD-3-Clause", "file", None, None), 11: (None, None, "BSD-3-Clause", "t"), 12: ("MIT", "header", None, None), 13: (None, None, "MIT", "n"), 14: ("MIT", "header", None, None),
        15: none, 16: ("Apache-2.0", "header", None, None), 17: (None, None, "MIT", "a/b"), None: (None, None, "Apache-2.0", "a"), 18: none,
    }


def test_licence_ties(spark, monkeypatch):
    monkeypatch.setattr(license, "templates", lambda: [("B", False, "wild words here"), ("A", False, "wild words here"), ("B", True, "whole licence of it"), ("A", True, "whole licence of it")])
    rows = [(1, "a/x", "wild words here"), (2, "a/y", "whole licence of it"), (3, "a/z", "nothing"), (4, "b/LICENSE", "wild words here"), (4, "b/LICENSE", "whole licence of it"), (5, "b/c", None)]
    found = sorted(tuple(r) for r in license.licensed(spark.createDataFrame(rows, "doc_id long, path string, text string")).select("doc_id", "own_license", "own_kind", "license").collect())
    assert found == [(1, "A", "header", "A"), (2, "A", "file", "A"), (3, None, None, "A"), (4, "A", "file", "A"), (4, "A", "file", "A"), (5, None, None, "A")]


def test_licence_bounds_lose_no_match(spark):
    rows, idf, other = license._model()
    weights, whole = collections.defaultdict(dict), {}
    for _, k, w, term, x in rows:
        weights[k][term], whole[k] = x, w
    rng, units = random.Random(4), [None, "", "...", "the " * 3000, "MIT " * 500, *[t.replace("\n", " ") for _, _, t in license.templates()]]
    for t in units[5:] * 6:
        words = [w for w in t.split() if rng.random() < 0.8] + [rng.choice(["x", "the", "license", "of", "word", "Version"]) for _ in range(rng.randint(0, 12))]
        rng.shuffle(words)
        units.append(" ".join(words))
    want, files = {}, {}
    for i, t in enumerate(units):
        c = collections.Counter(x for x in re.findall("[a-z0-9]+", (t or "").lower()) if x not in license.COMMON)
        x = {term: n * idf.get(term, other) for term, n in c.items()}
        norm = sum(v * v for v in x.values()) ** 0.5 or 1
        cosines = {k: sum(x.get(term, 0) * w for term, w in ws.items()) / norm if len(ws.keys() & x.keys()) >= license.SHARED else 0.0 for k, ws in weights.items()}
        want[i], files[i] = max(cosines.values()), max(v for k, v in cosines.items() if whole[k])
    df = spark.createDataFrame(list(enumerate(units)), "doc_id long, text string").withColumn("path", F.concat(F.lit("p"), F.col("doc_id"))).withColumn("line", F.lit("clash")).withColumn("n", F.lit(1))
    worth = got(df.select("doc_id", license.worth(F.col("text"), rows, idf, other).alias("worth")), "doc_id", "worth")
    assert all(worth[i][0] for i, c in want.items() if c >= 0.7) and not worth[3][0]
    lines = license.scanned(df).collect()
    assert {r.doc_id: r.cosine for r in lines if r.kind == "file"} == {i: pytest.approx(c, abs=2e-6) for i, c in files.items() if c >= 0.7}
    assert {r.doc_id: r.cosine for r in lines if r.line == 0} == {i: pytest.approx(c, abs=2e-6) for i, c in want.items() if c >= 0.7}
    assert license.licensed(df.limit(0)).count() == 0 and license.licensed(df.union(df)).count() == 2 * len(units)


def test_main_text(spark):
    page = '<html><body class="has-sidebar"><nav>menu</nav><div class="ad">buy</div><article><h1>T &amp; x</h1><p><b>one\n two<br><p>three</p><section id="comments">first!</section><form>f</form></article><footer>f</footer>'
    assert html_main.main_text(page) == "T & x\none two\nthree"
    assert html_main.main_text(None) == html_main.main_text("<nav>x</nav>") == ""
    assert html_main.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_main.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert H.unescape("&amp;") == "&"


def test_main_text_outside_of_articles():
    """Nothing but the named parts goes, wherever it stands and whatever else a name says."""
    m = html_main.main_text
    assert m("<main><h1>Title</h1><p>Intro</p><article><p>Body</p></article></main>") == "Title\nIntro\nBody"
    assert m('<div>The story</div><article class="teaser"><p>A teaser</p></article>') == "The story\nA teaser"
    assert m('<article><section class="related-work">a</section><div class="search-methods">b</div><p class="notice-board">c</p><p id="adjacent">d</p></article>') == "a\nb\nc\nd"
    for name in ("ad", "ads left", "site-header", "mainNav", "cookie-notice", "x comments-area", "related_items", "share-bar2", "footer"):
        assert m(f'<p>own</p><div class="{name}">gone</div>') == "own"
    assert m('<p>own</p><div id="cookie-notice">gone</div>') == "own"
    assert m('<body class="nav-open comments"><p>own</p></body>') == "own"


def test_templates_change_pages_without_articles(spark):
    """What is left of each page is known from how it was made."""
    rng, rows, want = random.Random(8), [], {}
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    for host in range(3):
        frame = ["<div><p>Slogan of {0}</p></div>", "<table><tr><td>Legal {0}</td></tr></table>", "<div><ul><li>one {0}</li><li>two</li></ul></div>"]
        for k in range(9):
            blocks, kept = [], []
            for _ in range(rng.randint(1, 6)):
                t = " ".join(word() for _ in range(rng.randint(1, 8)))
                tag = rng.choice(["p", "div", "h2", "blockquote", "section"])
                blocks.append(f"<{tag}>{t}</{tag}>")
                kept.append(t)
            for part in ('<nav>menu {1}</nav>', '<div class="side-bar sidebar">x {1}</div>', '<form>q {1}</form>', '<div id="comments"><p>reader {1}</p></div>', "<script>s {1}</script>", *frame):
                at = rng.randint(0, len(blocks))
                blocks.insert(at, part.replace("{0}", str(host)).replace("{1}", word()))
            i = 100 * host + k
            rows.append((i, f"https://h{host}.org/{k}", "<html><head><title>t</title></head><body>" + "".join(blocks) + "</body></html>"))
            want[i] = "\n".join(kept)
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.main_texts(d).collect()} == want
    assert all(html_main.main_text(h) != want[i] for i, _, h in rows)


def test_templates_against_brute_force(spark):
    slogan = "<div><div><em>Site slogan</em></div>"
    rows = [(i, f"http://h.org/{i}", f"{slogan}<p>own {i}</p></div>") for i in range(12)]  # a template
    rows += [(20 + i, f"http://copies.org/{i}", f"<p>the same</p><p>article {i // 9}</p>") for i in range(10)]  # copies: two pages
    rows += [(40 + i, f"https://me@few.org:8/{i}", f"{slogan}<p>own {i}</p></div>") for i in range(4)]  # too few pages
    rows += [(50 + i, f"http://half.org/{i}", f"<p>{'often' if i % 2 else i}</p><p>own {i}</p>") for i in range(10)]  # on half of them, not over half
    rows += [(60 + i, f"http://most.org/{i}", f"<div><p>{'often' if i % 3 else i}</p><p>own {i}</p></div>") for i in range(9)]
    rows += [(80, None, None), (80, None, ""), (None, "no address", "<p>x</p>"), (81, "http://h.org/0", rows[0][2]), (81, "http://h.org/0", rows[0][2])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit(2), "template": F.lit(3)})

    def expected(share, least):
        trees = [html_main.tree(h) for *_, h in rows]
        hosts = [re.sub("^.*@", "", u.split("/")[2]).split(":")[0] if u and "//" in u else "" for _, u, _ in rows]
        pages = collections.defaultdict(dict)
        for host, t in zip(hosts, trees, strict=True):
            hashes = sorted(html_main._signed(x) for x in html_main.subtree_hashes(t))
            same = html_main.text_of(html_main._containers(html_main.pruned(t)))
            pages[host][same] = min(pages[host].get(same, hashes), hashes)
        out = []
        for (i, _, h), host in zip(rows, hosts, strict=True):
            count = collections.Counter(x for hashes in pages[host].values() for x in hashes)
            n = len(pages[host])
            out.append((i, html_main.main_text(h, {x % (1 << 64) for x, c in count.items() if n >= least and c >= least and c > share * n})))
        return sorted(out, key=repr)

    found = {}
    for share, least in ((0.5, 5), (0.5, 3), (0.9, 5)):
        found[share, least] = sorted(((r.page_id, r.text) for r in html_main.main_texts(d, share, least).collect()), key=repr)
        assert found[share, least] == expected(share, least)
    texts_ = dict(found[0.5, 5])
    assert texts_[3] == "own 3" and texts_[21] == "the same\narticle 0" and texts_[41] == "Site slogan\nown 1" and texts_[51] == "often\nown 1" and texts_[61] == "own 1" and texts_[80] == ""
    assert dict(found[0.5, 3])[41] == "own 1" and dict(found[0.9, 5])[61] == "often\nown 1"


def test_warc(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (5, "v", "é" * 3000), (6, "w", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    found = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in found.items()} == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 6000), 6: ("response", None, 5)}
    assert all(r.error is None for r in found.values()) and bytes(found[5].payload).decode() == "é" * 3000
    assert found[6].payload_digest == warc.bare_digest(b"other")


def test_warc_of_rows_that_share_ids(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "same"), (1, "u", "other"), (2, "u", "same"), (2, "u", "same"), (2, "a", "same"), (None, "u", "same"), (None, "u", "alone"), (None, None, "twins"), (None, None, "twins"), (7, None, None), (8, "x\ny", "")]
    want = sorted(
        [(1, "u", "revisit", 2, b"same"), (1, "u", "response", None, b"other"), (2, "u", "response", None, b"same"), (2, "u", "revisit", 2, b"same"), (2, "a", "revisit", 2, b"same"), (None, "u", "revisit", 2, b"same"), (None, "u", "response", None, b"alone"),
         (None, "", "response", None, b"twins"), (None, "", "revisit", None, b"twins"), (7, "", "revisit", 8, b""), (8, "xy", "response", None, b"")], key=repr)
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "key": F.lit(2), "n": F.lit(3), "response": F.lit(4)})
    payload = {warc.bare_digest(p): p for *_, p in want}
    held = lambda df: sorted(((r.page_id, r.url, r.record_type, r.refers_to, payload[r.payload_digest]) for r in df.collect() if r.error is None and (r.record_type == "revisit" or bytes(r.payload) == payload[r.payload_digest])), key=repr)
    for hot in (100_000, 1):
        monkeypatch.setattr(warc, "HOT", hot)
        archives = warc.write_archives(d)
        assert held(warc.read_archives(archives)) == want
    for r in archives.collect():
        (tmp_path / r.name).write_bytes(bytes(r.content))
    assert held(warc.read_files(spark, str(tmp_path))) == want
    assert warc.read_archives(warc.write_archives(d.limit(0))).count() == 0


def test_broken_archives():
    good = warc.pack([warc.record(1, "u", b"x" * 100, warc.bare_digest(b"x" * 100), 100, False)])
    assert warc.parse(next(warc.frames(good)))["error"] is None
    with pytest.raises(ValueError):
        list(warc.frames(good[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(good + b"junk"))
    raw = next(warc.frames(good))
    assert warc.parse(raw.replace(b"xxx", b"yyy", 1))["error"] and warc.parse(raw[:-5])["error"] and warc.parse(b"HTTP/1.1\r\n\r\n")["error"]


def test_stages_tell_rows_apart_that_share_an_id(spark):
    rng = random.Random(6)
    say = lambda n=120: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, leak = say(), say(), say(), say()
    rows = [(1, a), (1, a), (1, b), (None, c), (None, leak), (2, leak), (2, say()), (3, "too short"), (3, say())]
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    held = lambda df: sorted((r.doc_id or 0, r.text) for r in df.select("doc_id", "text").collect())
    of = lambda xs: sorted((i or 0, t) for i, t in xs)
    assert held(quality.keep_good(d)) == of(x for x in rows if x[1] != "too short")
    assert held(near.keep_one(d)) == of(x for x in dict.fromkeys(rows) if x != (None, leak))
    assert held(suffix.without_repeats(d)) == of(x for x in dict.fromkeys(rows) if x != (None, leak))
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert held(decontam.without_leaks(d, bench)) == of(x for x in rows if x[1] != leak)
    words = collections.Counter()
    for r in mixing.in_order(d).collect():
        words[r.doc_id, r.text] += r.taken
    plan = collections.Counter()
    for r in mixing.mixed(d).collect():
        plan[r.doc_id] += r.taken
    assert {i: sum(n for (j, _), n in words.items() if j == i) for i in plan} == plan
    assert all(words[x] <= 2 * len(x[1].split()) * rows.count(x) for x in words)


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 200, 1000, 5000):
        a = {rng.getrandbits(64) for _ in range(n)}
        for m in (0, n // 10, n // 3, n):
            b = set(list(a)[m:]) | {rng.getrandbits(64) for _ in range(rng.randint(0, n))}
            x, y = (near.sketch(np.unique(np.array(sorted(s), np.uint64))) for s in (a, b))
            assert near.differing(x, y) == near.differing(y, x) <= len(a ^ b)
            assert near.differing(x, x) == 0
    far = [near.sketch(np.array(sorted({rng.getrandbits(64) for _ in range(400)}), np.uint64)) for _ in range(2)]
    assert near.differing(*far) > 800 / 9  # sets apart are ruled out


def test_wide_sketches_rule_out_no_match():
    rng = random.Random(21)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 900))}
        b = set(rng.sample(sorted(a), rng.randint(0, len(a)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 40))}
        x, y = (near.wide_sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
        apart = sum((int(p) ^ int(q)).bit_count() for p, q in zip(x.view(np.uint64), y.view(np.uint64), strict=True))
        assert len(x) == near.WIDE and apart <= len(a ^ b)
        if len(a & b) >= near.SIMILARITY * len(a | b):
            assert apart <= near.MOST_APART * (len(a) + len(b)) + 1e-9


def test_one_shingle_in_a_third_of_short_texts(spark, monkeypatch):
    """A sentence that a third of 900 short texts hold makes no rows for pairs, and every pair that is near is found."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    hot, rows = "all of these texts say just this", []
    for k in range(900):
        text = (hot + " " if k % 3 == 0 else "") + " ".join(word() for _ in range(14))
        rows.append((k, f"{rows[-1][1]} {word()}" if k % 9 == 1 else text))
    sets = [set(near.shingle_set(t.encode()).tolist()) for _, t in rows]
    pairs = [(a, b) for a in range(900) for b in range(max(0, a - 2), a) if len(sets[a] & sets[b]) >= near.SIMILARITY * len(sets[a] | sets[b])]
    made = []
    real = near.written
    monkeypatch.setattr(near, "written", lambda df, name: (lambda out: made.append(out.count()) or out if name == "pairs" else out)(real(df, name)))
    d = spark.createDataFrame([(k, t, None, None) for k, t in rows], "doc_id long, text string, lang string, source string").withColumn("_key", F.xxhash64("doc_id"))
    label = {r.doc_id: r.label for r in near.labelled(d).collect()}
    assert all(label[a] == label[b] for a, b in pairs) and len(pairs) > 20
    assert len(set(label.values())) == 900 - len(pairs) and sum(made) < 2000


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(800)]
    line = [rng.choice(vocabulary) for _ in range(40)]
    every = [None, "", "a b", "A B"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] + line * rng.randint(0, 2)
        for changed in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(changed):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            every.append(" ".join(t))
    sets = []
    for t in every:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    component, n = list(range(len(every))), 0
    for a in range(len(every)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n += every[a] != every[b]
                x, y = component[a], component[b]
                component = [min(x, y) if c in (x, y) else c for c in component]
    assert n > 20 and len(set(component)) > 30
    d = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(every)], "doc_id long, text string, lang string, source string")
    for rounds in (3, 1):
        monkeypatch.setattr(near, "ROUNDS", rounds)
        assert sorted(r.doc_id for r in near.keep_one(d).collect()) == sorted(set(component))
    assert near.keep_one(d.limit(0)).count() == 0
