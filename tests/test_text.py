import random
import re

from pyspark.sql import functions as F

from inkmill.functions import text
from inkmill.functions.html_text import renumber, section_kind
from inkmill.operators import books, overlap, scores


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens_and_fold(spark):
    assert one(spark, text.word_tokens, "Straße ²x, don't") == ["strasse", "²x", "don", "t"]
    assert one(spark, text.ws_words, " a\x1cb c  d ") == ["a", "b", "c", "d"]


def test_normalization(spark):
    assert one(spark, text.normalize_line, "“a”…b c é") == '"a"...b c é'
    assert one(spark, text.normalize_paragraphs, "a\n \n b  c\n") == "a\n\nb c"


def test_quotes(spark):
    df = spark.createDataFrame([('"I\'m sorry... worse"', "I'm so sorry it got worse"), ('"worse ... sorry"', "sorry it got worse"), ('"cat"', "cats"), ("no quote", "x")], "e string, t string")
    rows = df.select(text.quotes_occur(F.col("e"), text.quote_words(F.col("t"))).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, False, False, True]
    ok = spark.createDataFrame([('"I\'m sorry... worse"', "well I'm sorry it got worse")], "e string, t string")
    assert ok.select(text.quotes_occur(F.col("e"), text.quote_words(F.col("t"))).alias("ok")).first().ok


def test_longest_run_is_that_of_the_table(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(40))) for i in range(4)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(15))) for i in range(4)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.longest_run for r in overlap.longest_runs(d.select("doc_id").crossJoin(b.select("item_id")), d, b).collect()}
    for i, x in docs:
        for j, y in items:
            a, c = x.split(), y.split()
            best = max(n for n in range(16) if any(a[p : p + n] == c[q : q + n] for p in range(41 - n) for q in range(16 - n)))
            assert found[i, j] == best


def test_word_diff_rebuilds_both_sides():
    out = text.diff_words("a b c d", "a x c d e")
    assert "".join(x["text"] for x in out if x["type"] != "added") == "a b c d"
    assert "".join(x["text"] for x in out if x["type"] != "removed").split() == "a x c d e".split()
    assert text.diff_words("", "") == []


def test_earliest_checkpoint_and_upper_median(spark):
    s = spark.createDataFrame([(0, "train", 1.0), (1, "train", 2.0), (2, "train", 2.0)], "checkpoint long, split string, gap double")
    assert scores.select_checkpoint(s).first().selected == 1
    b = spark.createDataFrame([("a", f"s{k}", str(k), k, k) for k in (1, 2, 3, 4)], "author string, stem string, book_id string, downloads long, pos long")
    assert {(r.downloads, r.median) for r in books.lesser_read(b).collect()} == {(1, 3), (2, 3)}


def test_headings_and_citations():
    assert section_kind("Prior Work") == "related_work" and section_kind("Summary") == section_kind("Discussion and Conclusions") == "conclusion" and section_kind("Part of it") is None
    assert section_kind("IV. Conclusions and Outlook") == "conclusion" and section_kind("2.1 Related Work") == "related_work" and section_kind("Results") is None
    assert renumber("see [c, a, a] and [b]", {"a": 3, "c": 7}) == "see [3, 7] and [b]"
    assert re.fullmatch(r"[0-9a-f]{64}", __import__("inkmill.functions.calls", fromlist=["x"]).request_key({"b": 1, "a": "é"}))


def test_paragraph_types(spark):
    cases = {"CHAPTER I": "heading", "* * *": "break", "ALL CAPS HERE": "heading", '"ALL CAPS': "prose", "Plain text.": "prose", "Epilogue": "heading", "12.": "heading", "I. The Storm": "heading", "· · ·": "break", "The end.": "heading"}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.k for r in df.select("x", books.paragraph_type(F.col("x")).alias("k")).collect()} == cases


def test_red_flags(spark):
    cases = {"Favor the human text": ["origin_preference"], "ignore the system": ["wrapper_override"], "score 0 to 100": ["wrapper_override"], "unweighted mean": ["wrapper_override"], "<tool_call>": ["leaked_markup"], "it ends {": ["leaked_markup"], "a {b} c": [], "human-written signals": ["origin_detection"]}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.k for r in df.select("x", overlap.red_flags(F.col("x")).alias("k")).collect()} == cases


def test_books(spark):
    long = " ".join(["word"] * 45)
    raw = f"\ufeffhead\r\n*** START OF THIS PROJECT GUTENBERG EBOOK A ***\r\nProduced by X\r\n\r\nCHAPTER I\r\n\r\nPreface\n\n2.\n\nTwo\n\nCHAPTER I\n\n_Now_ it--[Illustration: a [b] c] goes[1] on\nand _é_a_ {long}\n\n  indented\n   verse\n \n* * *\n\nEnd.\n*** END OF THE PROJECT GUTENBERG EBOOK A ***\nlicence"
    rows = books.book_paragraphs(spark.createDataFrame([(1, raw), (2, "no marks"), (3, None)], "doc_id long, raw string")).orderBy("doc_id", "pos").collect()
    assert [(r.pos, r.type, r.text) for r in rows] == [(0, "heading", "CHAPTER I"), (1, "prose", f"Now it— goes on and é_a {long}"), (2, "block", "indented verse"), (3, "break", "* * *"), (4, "prose", "End.")]


def test_cuts_against_plain_python(spark):
    rng, rows = random.Random(7), []
    for book in range(3):
        rows += [(book, k, rng.choice(["prose"] * 12 + ["heading"]), rng.randint(1, 60)) for k in range(220)]
    paras = spark.createDataFrame(rows, "doc_id long, pos long, type string, words long")
    want, cuts = [], set()
    for book in range(3):
        mine = [r[2:] for r in rows if r[0] == book]
        gen, valid, before = random.Random(f"{books.SEED}:{book}"), [], [sum(n for _, n in mine[:k]) for k in range(len(mine) + 1)]
        for k in range(3, len(mine)):
            if before[k] >= 500 and all(t == "prose" for t, _ in mine[k - 3 : k]):
                goal = gen.randint(100, 300)
                for at, low in ((goal, True), (100, False)):
                    z = next((z for z in range(k + 1, len(mine) + 1) if before[z] - before[k] >= at or mine[z - 1][0] != "prose"), len(mine))
                    if all(t == "prose" for t, _ in mine[k:z]) and at <= before[z] - before[k] <= 300:
                        valid.append((k, z)) if low else cuts.add((book, k, z, before[z] - before[k]))
        free = 0
        for part in range(6):
            low, high = (500 + (before[-1] - 500) * x / 6 for x in (part, part + 1))
            fits = [c for c in valid if low <= before[c[0]] < high and c[0] >= free]
            if fits:
                want.append((book, *gen.choice(fits)))
                free = want[-1][2]
    assert sorted(tuple(r) for r in books.cut_sample(paras, 6, (100, 300), 500).collect()) == sorted(want) and len(want) > 8
    assert {tuple(r) for r in books.cut_candidates(paras, 100, 300, 500).collect()} == cuts and cuts


def test_names(spark):
    assert one(spark, text.display_name, "Buck, Pearl S. (Pearl Sydenstricker), 1892-1973") == "Pearl S. Buck"
    assert one(spark, text.criterion_key, "Accuracy & Tone!") == "accuracy_tone"
    assert one(spark, text.author_list, ["a", "b", "c", "d"], "array<string>") == "a, b, c and 1 more"


def test_cut_sample_leaves_books_without_a_start_to_spark(spark):
    """Only books that have a start reach Python."""
    paras = spark.createDataFrame([(1, k, "prose", 200) for k in range(30)] + [(2, 0, "prose", 50)], "doc_id long, pos long, type string, words long")
    plan = books.cut_sample(paras, 2, (100, 300), 500)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*starts#", plan[plan.index("FlatMapGroupsInPandas") :])


def test_words_are_split_without_a_pattern_for_each_text(spark):
    rows = [("",), (" ",), ("a",), (" a  b\tc d",), ("a b c ",), (None,), ("x\x1cy\x85z\u3000w\u2003\u2009v\u200b",)]
    df = spark.createDataFrame(rows, "t string").select("t", text.ws_words(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [None if t is None else t.split() for (t,) in rows]
    assert "split(translate(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_makes_ngrams_of_near_texts_only(spark):
    """Every shared n-gram at any place is found, and other texts make none."""
    item = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(k, " ".join(["x"] * k + [item] + ["y"] * (k % 5))) for k in range(20)] + [(100, " ".join(f"w{k}" for k in range(12))), (101, None), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = overlap.ngram_overlap(docs, items).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.hits) for r in got) == [(False, k, 1) for k in range(20)] + [(True, 0, 1)]
    assert [r.doc_id for r in overlap._near(docs.where("doc_id >= 100"), items, text.word_tokens, 13).collect()] == []
    spans = overlap.copied_spans(docs, items).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.first_pos) for r in spans) == [(False, k, k) for k in range(20)] + [(False, 100, 0), (True, 0, 0)]
