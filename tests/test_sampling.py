import random

import pytest
from pyspark.sql import functions as F

from inkmill.operators import sampling


def walk(rows, quotas):
    """The walk, row by row."""
    holders, out = {}, []
    for field, quota in quotas.items():
        n = 0
        for pos, i, a, t in sorted((p, i, a, t) for f, p, i, a, t in rows if f == field):
            keys = [("author", x) for x in dict.fromkeys(a) if x is not None] + [("title", x) for x in t if x is not None]
            held = {}
            for kind, x in keys:
                if (kind, x) in holders:
                    held.setdefault(kind, []).append(holders[kind, x])
            if n >= quota:
                out.append((field, pos, i, "full", None))
            elif held:
                kind = "author" if "author" in held else "title"
                out.append((field, pos, i, f"shared {kind}", min(held[kind])[2]))
            else:
                n += 1
                out.append((field, pos, i, "kept", None))
                holders |= dict.fromkeys(keys, (list(quotas).index(field), pos, i))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("authors", "quotas", "broadcast"), [(40, {"a": 4, "b": 3, "c": 0, "d": 50}, True), (400, {"d": 9, "a": 60}, False)])
def test_walk_as_row_by_row(spark, monkeypatch, authors, quotas, broadcast):
    """A hub author in a third of the rows, null and missing keys, equal places, fields without a quota or with none to fill."""
    if not broadcast:
        monkeypatch.setattr(sampling, "MOST_BROADCAST", 0)
    rng = random.Random(authors)
    rows = []
    for i in range(300):
        names = [rng.choice(["hub", None, f"x{rng.randrange(authors)}"]) for _ in range(rng.randint(0, 3))]
        rows.append((rng.choice("abcde"), rng.randrange(64), i, names, [rng.choice([None, f"t{rng.randrange(150)}"])]))
    df = spark.createDataFrame(rows, "field string, pos long, id long, author array<string>, title array<string>")
    got = sampling.conflict_free(df, quotas, ["author", "title"], bits=6).collect()
    assert sorted(repr(tuple(r)) for r in got) == walk(rows, quotas)


def test_walk_sorts_what_its_quotas_need(spark, monkeypatch):
    """With small quotas, few of the rows' keys are written."""
    written, stage = {}, sampling.stage
    monkeypatch.setattr(sampling, "stage", lambda df, name: written.setdefault((name, len(written)), stage(df, name)))
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(1 << 12), i, [f"x{rng.randrange(900)}" for _ in range(3)], [f"t{i % 700}"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "field string, pos long, id long, author array<string>, title array<string>")
    monkeypatch.setattr(sampling, "removed", lambda df: None)
    got = sampling.conflict_free(df, {"a": 3, "b": 4}, ["author", "title"], bits=12).collect()
    assert sorted(repr(tuple(r)) for r in got) == walk(rows, {"a": 3, "b": 4})
    counts = [df.count() for (name, _), df in written.items() if name in ("keys", "open")]
    assert sum(counts) < len(rows)


def test_walk_of_nothing(spark):
    df = spark.createDataFrame([], "field string, pos long, id long, author array<string>")
    assert sampling.conflict_free(df, {"a": 1}, ["author"]).collect() == []


def test_bottom_k(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "", "a", "b"]), rng.choice([None, rng.randrange(1 << 60), 5]), i) for i in range(600)]
    got = sampling.bottom_k(spark.createDataFrame(rows, "f string, draw long, id long"), "f", "draw", 7, "id").collect()
    want = []
    for f in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[:7]
        want += [(*r, k) for k, r in enumerate(mine, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_bottom_k_adds_up_before_it_travels(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("f"), sampling.seeded(1, F.col("id")).alias("draw"), "id")
    plan = sampling.bottom_k(df, "f", "draw", 5, "id")._jdf.queryExecution().toString()
    assert "partial_count" in plan
