"""Queries and steps whose work has to follow their input, and no more."""

import hashlib
import random
import time

import pytest

from inkmill.functions import html_text, papers, text
from inkmill.operators import estimates
from inkmill.plans import queries


def test_feedback_is_of_graded_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "en" if i % 2 else "fr", "a", (i * 31) % 400) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.example_id, r.kind, r.gap, r.reference_hash) for r in queries.q_feedback(spark, str(tmp_path)).collect()}
    want = sorted((round((n % 101 - i * 37 % 101) / 10, 6), i, lang, t) for i, t, lang, _, n in rows if i % 3 and i % 17 and i % 19)
    assert got == {(i, lang, gap, hashlib.sha256(t.encode()).hexdigest()) for gap, i, lang, t in want[:24] if gap <= 0}


def test_estimates_compare_with_few_endpoints(spark):
    rng = random.Random(4)
    listed = []
    for k in range(400):
        limits = "".join(f',"{n}":{rng.randint(*r)}' for n, r in (("context_length", (50, 400)), ("max_completion_tokens", (20, 200))) if rng.random() < 0.9)
        listed.append(f'{{"provider_name":"p{rng.randint(1, 50)}"{limits},"pricing":{{"prompt":"0.{rng.randint(0, 60):03}","completion":"0.{rng.randint(0, 60):03}"}},"supported_parameters":{rng.choice(["[]", chr(91) + chr(34) + "seed" + chr(34) + chr(93), chr(91) + chr(34) + "tools" + chr(34) + "," + chr(34) + "seed" + chr(34) + chr(93), "null"])}}}')
    listings = spark.createDataFrame([('{"data":{"id":"m","endpoints":[' + ",".join(listed) + "]}}",)], "json string")
    asked = [(k, "m", rng.choice([0, 0, None, -5, *range(1, 400, 40)]), rng.choice([0, 0, None, *range(1, 220, 20)]), rng.choice([None, [], ["seed"], ["tools"], ["seed", "tools"]])) for k in range(300)]
    requests = spark.createDataFrame(asked, "id int, model string, prompt_tokens long, completion_tokens long, needs array<string>")
    got = {r.id: (r.provider, r.cost) for r in estimates.priced(requests, listings).collect()}
    all_, few = ([(e, g.parameters) for r in estimates.endpoints(listings).collect() if r.free is x for g in r.endpoints for e in g.of] for x in (True, False))
    assert len(all_) == 400 and len(few) < 200

    def one(a, b, needs):
        if a is None or b is None:
            return None, None
        fit = [e for e, has in all_ if (e.context is None or a + b <= e.context) and (e.most is None or b <= e.most) and set(needs or []) <= set(has)]
        cost, provider = min(((e.prompt * a + e.completion * b, e.provider) for e in fit), default=(None, None))
        return provider, cost

    # a request with an unknown number of tokens fits where no limit is told, at no known cost
    assert {k: v for k, v in got.items() if None not in asked[k][2:4]} == {k: one(a, b, needs) for k, _, a, b, needs in asked if None not in (a, b)}
    assert all(got[k][1] is None for k, _, a, b, _ in asked if None in (a, b))


def test_near_dedup_links_by_simhash_first(spark, monkeypatch):
    """What is linked is the same with and without SimHash, which links some by itself; many pairs between two components are one link."""
    near = pytest.importorskip("inkmill.llm.near")
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(400)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, k, " ".join(t)))
    rows += [(100 + k, 100 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(20)] + [(200, 200, ""), (201, 201, None)]
    docs = spark.createDataFrame(rows, "_key long, doc_id long, text string")
    sets = {k: {*near.shingle_set((t or "").encode()).tolist()} for k, _, t in rows}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = {k: group[b] if g == group[a] else g for k, g in group.items()}
    parts = lambda label: sorted(sorted(k for k in label if label[k] == g) for g in set(label.values()))
    asked, links = [], near.merged
    monkeypatch.setattr(near, "merged", lambda label, pairs: asked.append((label is None, pairs.count())) or links(label, pairs))
    group[201] = group[200]
    assert parts({r._key: r.label for r in near.labelled(docs).collect()}) == parts(group)
    assert asked and asked[0][0]
    cards = spark.createDataFrame([(k, n) for k, n in enumerate([0, 7, 7, 1 << 40, 255])], "v long, fp long")
    assert {(r.a, r.b) for r in near.by_fingerprint(cards).collect()} == {(1, 2), (0, 1), (0, 3)}
    label = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, label long")
    pairs = spark.createDataFrame([(1, 5), (2, 6), (2, 5), (8, 9)], "a long, b long")
    assert {tuple(r) for r in links(label, pairs).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)}


def test_texts_reach_python_by_the_hundred(spark):
    """Arrow's batches of ten thousand texts and their results made a worker's memory follow the input."""
    rows = [(k, f"e\u0301 {k}" if k % 7 else None) for k in range(1_000)]
    df = spark.createDataFrame(rows, "k int, t string")
    for made in (text.normalize_line("t"), text.normalize_paragraphs("t"), html_text.html_text("t"), papers._papers("t")):
        plan = df.select("k", made.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    got = {r.k: (r.a, r.b) for r in df.select("k", text.normalize_line("t").alias("a"), html_text.html_text("t").alias("b")).collect()}
    assert got == {k: (None if t is None else f"\u00e9 {k}", t or "") for k, t in rows}


def test_papers_are_read_once(spark, tmp_path):
    """A filter on what a page says was pushed below it as a second reading of the page."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(100 + 60 * (k % 2)))) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for q in (queries.q_paper_examples, queries.q_paper_rejects):
        plan = q(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython [") == 1
    fit = {k for k, _ in rows if k % 2 and k % 13 and k % 7 and k % 11}
    assert {(int(r.source_id), r.kind, r.target_words) for r in queries.q_paper_examples(spark, str(tmp_path)).collect()} == {(k, *x) for k in fit for x in (("abstract", 80), ("introduction", 82))}
    assert {int(r.paper_id) for r in queries.q_paper_rejects(spark, str(tmp_path)).collect()} == {k for k, _ in rows} - fit


def test_papers_cost_what_they_hold():
    """Every item and every citation went through all elements of the page; an open element made each end tag go through all that were open."""

    def took(n: int) -> float:
        items = "".join(f'<li class="ltx_bibitem" id="b{k}"><span class="ltx_tag_bibitem">X</span> t{k}' for k in range(n))
        cites = "".join(f'<p>w{k} <cite class="ltx_cite"><a href="#b{k}">x</a></cite>' for k in range(n))
        html = f'<article class="ltx_document"><div class="ltx_abstract" id="a">{"<b>y</b> " * n}</div><section class="ltx_section" id="s"><h2>Introduction</h2>{cites}</section><ul>{items}</ul></article>'
        began = time.process_time()
        got = papers.paper_of(html)
        assert got["items"] == n and [len(x["reference"].split()) for x in got["sections"]] == [n, 2 * n] and " ".join(got["sections"][0]["context"].split()).endswith(f"[{n}] t{n - 1}")
        return time.process_time() - began

    assert min(took(2000) for _ in range(2)) < 60 * min(took(100) for _ in range(5))


def test_plain_tags_are_read_as_the_library_reads_them():
    class Library(papers._Page):
        parse_starttag, parse_endtag, updatepos = papers.HTMLParser.parse_starttag, papers.HTMLParser.parse_endtag, papers.HTMLParser.updatepos

    rng = random.Random(6)
    parts = ['<p class="a b">', "</p>", '<a href="#b1" id="x">', "</a>", "<br>", "<br/>", "</br>", "<P>", '<p id="a&amp;b">', '<p a="x>y">', "<p a=1 b>", '<p id="1"id="2">', '<p id="1" id="2">', "</p >", "<script>", "</script>", "<textarea>", "</textarea>", "<title>", "</title>", "<!-- <p> -->", "<", "&lt;", "text ", "<h1>", "</h1>", "<x-y>", '<p id="">', "<p\n>"]
    for _ in range(300):
        html = "".join(rng.choices(parts, k=30))
        mine, theirs = papers._Page(html), Library(html)
        assert (mine.elements, mine.texts) == (theirs.elements, theirs.texts), html
