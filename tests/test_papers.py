import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions import papers
from inkmill.operators import books, lifecycle, reports
from inkmill.sources import files

A, B = " ".join(f"a{k}" for k in range(70)), " ".join(f"b{k}" for k in range(70))


def page(abstract=f'<div class="ltx_abstract" id="ab"><h6>Abstract</h6><p>{A}</p></div>', intro=B, head="1 Introduction", ident='id="S1"', more="", items=10):
    bib = "".join(f'<li class="ltx_bibitem" id="b{k}"><span class="ltx_tag_bibitem">X (19{k})</span> t{k}</li>' for k in range(1, items + 1))
    return f'<html><body><nav>menu<article class="ltx_document">{abstract}<section class="ltx_section" {ident}><h2>{head}</h2><p>{intro}</p></section>{more}<ul>{bib}</ul></article>tail'


SECOND = '<section class="ltx_section"><h2>Prior work</h2></section><section class="ltx_section"><h2>II. Related Works.</h2></section>'
REASONS = {
    "<p>no paper": "Page has no LaTeXML document (.ltx_document)",
    page(abstract=""): "Page has 0 abstracts; expected 1",
    page(more=SECOND): "Found a second top-level related_work section, headed 'related works'",
    page(head="Methods"): "Top-level sections not found: introduction",
    page(items=9): "Bibliography has 9 entries; at least 10 required",
    page(more='<b class="ltx_ERROR">x</b>�'): "Page has 1 LaTeXML error node(s) and 1 U+FFFD character(s)",
    page(intro=B + " <b>Acknowledgements.</b>"): "introduction contains acknowledgements the markup does not set apart",
    page(intro="too short"): "introduction has 2 words; at least 60 required",
    page(ident=""): "introduction section has no HTML id",
    page(more=f"<p>{B}</p>"): "introduction text also appears elsewhere in the paper, so removing it does not hide it",
}


def test_each_rule_rejects(spark):
    df = spark.createDataFrame([*enumerate(REASONS), (98, page()), (99, None)], "page_id long, html string")
    got = {r.paper_id: r.reason for r in papers.rejected(papers.read_papers(df, "page_id", "html")).collect()}
    assert got == {str(k): v for k, v in enumerate(REASONS.values())} | {"99": "Page has no LaTeXML document (.ltx_document)"}


def test_examples_hide_their_section(spark):
    intro = (
        f'{B} <cite class="ltx_cite">see <a href="#b7">Z</a>, <cite class="ltx_cite"><a href="#b3">Y</a></cite></cite> and <cite class="ltx_cite"><a href="#q">Q</a></cite>'
        '<math alttext="n"><annotation encoding="application/x-tex">x^{2}</annotation><mi>x</mi></math>, <math alttext="y_1"><mi>y</mi></math>'
        '<figure class="ltx_figure"><p>drawn</p></figure>end <b>T</b>HE “é”<script>no()</script>'
    )
    df = spark.createDataFrame([(5, page(intro=intro, more='<section class="ltx_section" id="S9"><h2>9 Results</h2>kept</section>'))], "page_id long, html string")
    rows = {r.kind: r for r in papers.examples(papers.read_papers(df, "page_id", "html")).collect()}
    bib = " ".join(f"[{k}] t{k}" for k in range(1, 11))
    assert rows["introduction"].reference == f'{B} [3, 7] and Qx^{{2}}, y_1end THE "é"'
    assert rows["introduction"].context == f"Abstract {A} [Missing introduction section] 9 Results kept {bib}"
    assert rows["abstract"].reference == A and rows["abstract"].example_id == "5_abstract" and rows["abstract"].bibliography_items == 10
    assert rows["abstract"].context == f'[Missing abstract section] 1 Introduction {B} [3, 7] and Qx^{{2}}, y_1 drawn end THE "é" 9 Results kept {bib}'
    assert papers.examples(papers.read_papers(df.limit(0), "page_id", "html")).count() == 0


def test_quota_walk(spark):
    rng = random.Random(3)
    rows = [(f"a{a}", a, f"{a}-{k}", k, rng.random() < 0.6) for a in range(12) for k in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "author string, author_pos long, book_id string, pos long, fit boolean")
    needs = {"train": 7, "validation": 4, "confirmation": 3}
    got = books.quota_walk(df, needs, 3, 1).collect()
    fit = {r[2] for r in rows if r[4]}
    assert {s: sum(r.split == s for r in got) for s in needs} == needs and {r.book_id for r in got} <= fit
    splits = {}
    for r in got:
        splits.setdefault(r.author, set()).add(r.split)
    assert all(len(s) == 1 for s in splits.values()) and max(sum(r.author == a for r in got) for a in splits) <= 3
    order = [f"a{a}" for a in range(12)]
    random.Random(1).shuffle(order)
    assert list(dict.fromkeys(r.author for r in got)) == [a for a in order if a in splits]
    assert sorted(map(tuple, books.quota_walk(df.repartition(5), needs, 3, 1).collect())) == sorted(map(tuple, got))
    for wrong in (books.quota_walk(df, {"train": 99}), books.quota_walk(df, needs, most=5)):
        with pytest.raises(Exception, match="not enough|at most"):
            wrong.collect()


def test_replies(spark):
    replies = {'{"choices":[{"message":{}}]}': True, '{"choices":[{"message":{"content":1}}]}': False, '{"choices":{}}': False, "no json": False, '{"choices":[{"message":{"content":"x"}}],"error":""}': True, '[1]': False}
    df = spark.createDataFrame([(x,) for x in [*replies, None]], "x string")
    x = F.col("x")
    got = {r.x: (r.v, r.ok, r.c) for r in df.select("x", lifecycle.valid_choice(x).alias("v"), lifecycle.succeeded(F.lit(200), x).alias("ok"), lifecycle.closed(x, "choices").alias("c")).collect()}
    assert got == {k: (v, v, k.startswith('{"choices') and "error" not in k) for k, v in replies.items()} | {None: (False, False, False)}


def test_costs(spark):
    answers = {"a": {"id": "a", "total_cost": 1}, "b": {"id": "x", "total_cost": 1}, "c": {"id": "c", "total_cost": float("nan")}, "d": {"id": "d", "total_cost": -1}, "e": {"id": "e"}, "f": {"id": "f", "total_cost": True}}
    df = spark.createDataFrame([(x,) for x in [*answers, *answers, None]], "generation_id string")
    got = {r.generation_id: (r.cost, r.error is None) for r in lifecycle.costs(df, answers.__getitem__).collect()}
    assert got == {"a": (1.0, True)} | dict.fromkeys("bcdef", (None, False))


def test_splits_and_numbers(spark):
    df = spark.createDataFrame([("train", 1.5, "12345"), ("validation", None, "7"), ("other", -0.25, "")], "split string, x double, id string")
    assert reports.of_splits(df, "train").count() == 1
    with pytest.raises(ValueError, match="trian"):
        reports.of_splits(df, "trian")
    assert [tuple(r) for r in df.select(reports.signed(F.col("x")), reports.digits_path(F.col("id"))).collect()] == [("+1.50", "1/2/3/4"), ("–", "0"), ("-0.25", "0")]


def test_files(spark, tmp_path):
    made = []
    for _ in range(2):
        got = files.cached(spark, f"{tmp_path}/t", lambda: made.append(1) or spark.range(3))
        assert got.count() == 3
    assert len(made) == 1
    files.write_record(spark, {"b": 1, "a": "é"}, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").first().value == '{"a":"é","b":1}'
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_record(spark, {}, f"{tmp_path}/r")
    df = spark.createDataFrame([("o", "n"), (None, "m")], "paper_id string, source_id string")
    assert [r.source_id for r in files.aliased(df, {"paper_id": "source_id", "section_type": "kind"}).collect()] == ["o", "m"]
