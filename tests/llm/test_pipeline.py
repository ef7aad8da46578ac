"""The pipeline's stages, one after the other, against plain Python over all rows, pairs and windows."""

import collections
import hashlib
import math
import random
import re

import pytest

from inkmill.llm import mixing, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
W = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(21)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    passage, bench = say(60), [(k, " ".join(say(30))) for k in range(6)] + [(None, " ".join(say(25))), (3, None), (5, " ".join(say(20)))]
    rows = [(None, None, "en", "a"), (1, "", None, None), (2, "too short", "en", "a"), (3, None, "fr", None)]
    for i in range(10, 120):
        t = say(rng.randint(60, 160))
        if i % 10 == 0:
            t[20:20] = passage
        if i % 13 == 0:
            t[30:30] = (bench[i % 6][1]).split()[i % 2 * 15 :] + (bench[i % 6][1]).split()[: i % 2 * 15]  # whole, or rotated
        if i % 17 == 0:
            t = [w + "#%&" for w in t]
        rows.append((i, (" " if i % 3 else "\n").join(t), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "c", None])))
        if i % 9 == 0:
            near = list(t)
            near[len(t) // 2] = "changed"
            rows.append((1000 + i, " ".join(near), "en", "b"))
        if i % 11 == 0:
            rows.append((2000 + i, rows[-1][1], "fr", "c"))
    rows += [rows[20], rows[20], (None, " ".join(say(90)), "en", "a"), (40, " ".join(say(80)), "en", "b")]
    return rows, bench


def good(rows):
    facts = []
    for _, t, _, _ in rows:
        t = t or ""
        w, lines = W.findall(t), [x for x in t.split("\n") if W.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        twice = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        f = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_upper": sum(c.isupper() for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice)}
        f["ok"] = not (f["n_words"] < 50 or 100 * len(twice) > 50 * len(w))
        facts.append(f)

    def at_level(some, part, whole, level):
        rates = sorted((facts[k][part] + 0.5) / (facts[k][whole] + 1) for k in some)
        return quality.GAMMA ** math.ceil(math.log(rates[max(0, -(-level * len(rates) // 1000) - 1)]) / math.log(quality.GAMMA)) if rates else 0.0

    passed, out = [k for k, f in enumerate(facts) if f["ok"]], []
    for k in passed:
        ok = True
        for part, whole, level in quality.RATES.values():
            fence, n = at_level(passed, part, whole, level), quality.SHRINK
            for some in ([j for j in passed if rows[j][2] == rows[k][2]], [j for j in passed if rows[j][2:] == rows[k][2:]]):
                fence = (len(some) * at_level(some, part, whole, level) + n * fence) / (len(some) + n)
            ok = ok and facts[k][part] - quality.ERRORS * facts[k][part] ** 0.5 <= quality.STRETCH * fence * facts[k][whole] + 1e-9
        if ok:
            out.append(rows[k])
    return out


def apart(rows):
    sets = []
    for _, t, *_ in rows:
        w = W.findall(t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return list(best.values())


def cut(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        t, gone = r[1], bytearray(len(r[1]))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        left = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        if W.search(left):
            out.append((r[0], left, *r[2:]))
    return out


def clean(rows, bench):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []

    def leaks(t):
        a = shingles(t)
        for _, x in bench:
            b = shingles(x)
            for s in range(max(1, len(a) - len(b) + 1)) if b else ():
                part = a[s : s + len(b)]
                both = sum((collections.Counter(part) & collections.Counter(b)).values())
                if both and both / (len(part) + len(b) - both) >= 0.8:
                    return True
        return False

    return [r for r in rows if not leaks(r[1])]


def mixed(rows):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    total = collections.Counter()
    for _, t, _, source in rows:
        total[source] += len(W.findall(t))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), mixing.SHARE * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] <= level * weight[s]}
        target |= {s: 2 * total[s] if full else level * weight[s] for s in full or free}
        left, free = left - sum(2 * total[s] for s in full), free - full if full else set()
    out = []
    for k, s in enumerate(names):
        tilt, goal, before = mixing.TILTS[k % 3], round(target[s]), 0
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (int(md5(f"{mixing.SEED} {'-' if r[0] is None else r[0]} {md5(r[1])}")[:15], 16),))
        for r in mine:
            n = len(W.findall(r[1]))
            for turn in range(3):
                at = before + turn * total[s]
                if n and at < goal:
                    a, part = 1 - tilt, at / goal
                    out.append((r[0], r[1], turn, min(n, goal - at), round(part if not tilt else (math.sqrt(a * a + 4 * tilt * part) - a) / (2 * tilt), 6)))
            before += n
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, bench = corpus()
    d = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    by_key = lambda xs: sorted(xs, key=repr)
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    steps = [good, apart, cut, lambda x: clean(x, bench)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        before, want = want, step(want)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = docs.collect()
        assert by_key((r.doc_id, r.text, r.lang, r.source) for r in found) == by_key(want), name
        assert docs.columns == d.columns and all(r.n_chars == len(r.text) for r in found)
        assert 20 < len(want) and by_key(want) != by_key(before), name
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert by_key((r.doc_id, r.text, r["pass"], r.taken, round(r.position, 6) + 0.0) for r in whole) == by_key(mixed(want))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Other columns stay with their rows, whatever the stages call their own; those that mixing makes are replaced."""
    rng = __import__("random").Random(12)
    names = ["_key", "_n", "c_kept", "_plan", "_plans", "others", "b_th", "k", "a.b", "w", "h", "kept", "label"]
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90)), "en", f"s{i % 2}", None, *[f"{n}{i}" for n in names]) for i in range(40)]
    passage = " ".join(rows[0][1].split()[:40])
    rows[7] = (7, rows[7][1] + " " + passage, *rows[7][2:])
    schema = "doc_id long, text string, lang string, source string, taken string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = set(range(40))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left -= {3} if name == "benchmark decontamination" else set()
        found = docs.collect()
        assert {r.doc_id for r in found} == left and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names), name
        assert docs.columns[:4] == ["doc_id", "text", "lang", "source"] and [c for c in docs.columns if c in names] == names
        if name == "suffix-array dedup":
            assert len([r for r in found if r.doc_id == 7][0].text) < len(rows[7][1])
    assert docs.columns[-3:] == ["pass", "taken", "position"] and dict(docs.dtypes)["taken"] == "bigint"
