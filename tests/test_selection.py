import random
import re
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkmill.functions import text
from inkmill.operators import catalogs, estimates, intervals, overlap, scores


def test_folding_is_that_of_python(spark):
    # letters that the older of the two versions of Unicode doesn't know fold by the newer one alone
    rows = [(chr(c),) for c in range(1, 0x2FA20) if unicodedata.category(chr(c)) not in ("Cs", "Cn") and not 0x1C89 <= c <= 0x1C8A] + [("ΟΔΟΣ ſtraße ﬁn İ ẞ ᾳ Ꭰ",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert not [r.t for r in got if r.t is not None and r.f != r.t.casefold()]


def reason(row, authors, excluded):
    """The rules, one by one."""
    i, kind, title, language, names, subjects = row
    names = [n.strip() for n in (names or "").split(";") if n.strip()]
    first, subject, title = [n for n in names if "[" not in n], (subjects or "").casefold(), " ".join((title or "").split())
    rules = [
        (kind != "Text", "not a text"), (language != "en", "not in English"), (i in excluded, "excluded"), (len(first) != 1, "not one principal author"), (first[:1] != [] and first[0] not in authors, "not an author of the list"),
        (not all(n in first or n.endswith("[Illustrator]") for n in names), "names others than illustrators"), ("fiction" not in subject, "not fiction"), (any(w in subject for w in ("short stories", "drama", "poetry", "juvenile")), "another kind of fiction"),
        (bool(re.search(r"\bvol(?:ume|\.)?\s*(?:\d|[ivx]+\b)|\b(?:stories|tales|essays|sketches)\b", title, re.I)), "a volume or a collection"),
    ]
    return next((said for bad, said in rules if bad), None)


def test_catalog_rules(spark):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    rows = [
        (
            i, pick("Text", "Text", "Text", "Sound", None), pick("The  Book\r\nof x", "Vol. 2 of y", "Volume ix", "Volition", "vol x", "Tales of", "TALES", "Storiesx", None, "a vol.\n12"), pick("en", "en", "en", "fr", None),
            pick("Ann", "Ann; Bob", "Ann; Cy [Illustrator]", " Ann ;; ", "Ann; Cy [Translator]", "Cy [Editor]", "Dee", "", None, "Bob"), pick("Fiction", "Science FICTION; x", "Drama; fiction", "Poetry", "Short Stories -- Fiction", "JUVENILE fiction", None, "Fiction"),
        )
        for i in range(600)
    ]
    authors, excluded = {"Ann", "Bob"}, set(range(0, 600, 17))
    df = spark.createDataFrame(rows, "book_id long, type string, title string, language string, authors string, subjects string")
    got = catalogs.catalog(df, spark.createDataFrame([(a,) for a in authors], "name string"), spark.createDataFrame([(e,) for e in excluded], "book_id long")).collect()
    assert {r.book_id: r.reason for r in got} == {r[0]: reason(r, authors, excluded) for r in rows}
    kept = [r for r in got if r.reason is None]
    assert kept and {r.author for r in kept} == authors and all(r.title == " ".join(r.title.split()) for r in got)


def test_rights_and_lengths(spark):
    rows = [(1, "Public domain in the USA.", 30_000), (2, "Public domain in the USA.", 29_999), (3, "Copyrighted.", 90_000), (4, None, 1), (5, "Public domain in the USA.", None)]
    got = catalogs.eligible(spark.createDataFrame(rows, "book_id int, rights string, story_words int")).collect()
    short = "Story has {} words; at least 30000 required"
    assert {r.book_id: r.reason for r in got} == {1: None, 2: short.format(29999), 3: "Rights: Copyrighted.", 4: "Rights: ", 5: short.format(0)}


def test_interval_against_plain_python(spark):
    import hashlib

    rng = random.Random(6)
    rows = [(rng.choice("pq"), rng.choice([None, "a", "b", "c", "", "e", "f"]), rng.choice([None, round(rng.uniform(-3, 5), 3)])) for _ in range(300)]
    draw = lambda k: int(hashlib.sha256(f"9:{k}".encode()).hexdigest()[:15], 16)
    names = sorted({s for _, s, _ in rows}, key=lambda s: draw("" if s is None else f"={s}"))
    picks = [[draw(f"{b}:{j}") % len(names) for j in range(len(names))] for b in range(50)]
    want = {}
    for g in "pq":
        values = {s: [v for x, y, v in rows if x == g and y == s and v is not None] for s in names}
        means = sorted(sum(x) / len(x) for p in picks if (x := [v for k in p for v in values[names[k]]]))
        at = lambda q: (lambda k: means[int(k)] + (k - int(k)) * (means[min(int(k) + 1, len(means) - 1)] - means[int(k)]))(q * (len(means) - 1))  # noqa: B023, E731
        every = [v for x in values.values() for v in x]
        want[g] = (sum(map(bool, values.values())), len(every), *[pytest.approx(v, abs=2e-6) for v in (sum(every) / len(every), at(0.05), at(0.95))])
    got = intervals.source_interval(spark.createDataFrame(rows, "g string, s string, v double"), ["g"], "s", "v", 50, 9, 0.9).collect()
    assert {r.g: tuple(r)[1:] for r in got} == want
    assert intervals.source_interval(spark.createDataFrame([], "g string, s string, v double"), ["g"], "s", "v", 5).collect() == []
    (one,) = intervals.source_interval(spark.createDataFrame(rows, "g string, s string, v double"), [], "s", "v", 5).collect()
    assert one.n == sum(r[2] is not None for r in rows) and one.low <= one.high


@pytest.mark.parametrize(("row", "said"), [((2, "validation", 1.0), "needs training rows"), ((2, "train", None), "grade is missing")])
def test_feedback_of_bad_rows_fails(spark, row, said):
    rows = [(1, "train", 0.5), row]
    with pytest.raises(PySparkException, match=said):
        scores.guarded(spark.createDataFrame(rows, "id int, split string, gap double")).collect()
    assert scores.guarded(spark.createDataFrame(rows[:1], "id int, split string, gap double")).count() == 1


def test_numbers_of_names(spark):
    df = spark.createDataFrame([(None,), ("",), *[(f"s{k}",) for k in range(500)]], "s string")
    got = intervals.numbered(df, "s", 3).collect()
    assert sorted(r["index"] for r in got) == list(range(502))


def test_identifiers_in_texts(spark, monkeypatch):
    """Overlapping, nested and repeated identifiers, in blocks; folded; short ones and null texts have none."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abß ") for _ in range(n))
    docs = [(k, word(60)) for k in range(80)] + [(90, None), (91, ""), (91, "STRASSE"), (None, "straße")]
    ids = [(word(rng.randint(3, 7)),) for _ in range(60)] + [("straSSe",), ("trass",), (None,)]
    f = lambda t: t.casefold()
    known = {f(i) for (i,) in ids if i is not None and len(f(i)) >= 5}
    want = sorted(((d, i) for d, t in docs if t is not None for i in known if i in f(t)), key=repr)
    for most in (100_000, 7):
        monkeypatch.setattr(overlap, "MOST_IDENTIFIERS", most)
        got = overlap.identifier_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ids, "identifier string")).collect()
        assert sorted(map(tuple, got), key=repr) == want and len(want) > 50


def test_cheapest_endpoint_that_takes_a_request(spark):
    """Limits that are missing, prices that are none, what a request needs, ties by name; sums are exact."""
    import json
    from decimal import Decimal

    def endpoint(name, prompt, completion, context=None, most=None, parameters=("seed",)):
        return {"provider_name": name, "context_length": context, "max_completion_tokens": most, "pricing": {"prompt": prompt, "completion": completion, "discount": 0}, "supported_parameters": parameters and list(parameters), "more": [1]}

    a = [endpoint("small", "0.00000001", "0.00000001", 100, 50), endpoint("large", "0.00000125", "0.00000425", 1000), endpoint("b", "0.00000125", "0.00000425"), endpoint("free?", None, "0"), endpoint("odd", "x", "1"), endpoint("tools", "0.1", "0.3", parameters=("tools", "seed")), endpoint("bare", "0", "0", 10, parameters=None)]
    listings = spark.createDataFrame([(json.dumps({"data": {"id": "m", "endpoints": a}}),), ("no json",), (json.dumps({"data": {"id": "n", "endpoints": []}}),)], "json string")
    rows = [(1, "m", 50, 50, ["seed"]), (2, "m", 50, 51, ["seed"]), (3, "m", 2000, 3, None), (4, "m", 1, 1, ["tools"]), (5, "m", 1, 1, ["logprobs"]), (6, "n", 1, 1, []), (7, "unheard", 1, 1, []), (8, "m", 3, 3, [])]
    requests = spark.createDataFrame(rows, "id int, model string, prompt_tokens long, completion_tokens long, needs array<string>")
    got = {r.id: (r.provider, r.cost) for r in estimates.priced(requests, listings).collect()}
    d = Decimal
    assert got == {1: ("small", d("0.000001")), 2: ("b", d("0.00027925")), 3: ("b", d("0.00251275")), 4: ("tools", d("0.4")), 5: (None, None), 6: (None, None), 7: (None, None), 8: ("bare", d(0))}
    (one,) = estimates.estimate(requests.withColumn("role", F.lit("r")), listings, "role").collect()
    assert (one.requests, one.unfit, one.cost, one.with_reserve) == (8, 3, d("0.402793"), d("0.50349125"))
