import datetime
import random

import pytest
from pyspark.sql import functions as F

from inkmill.operators import audit

SCHEMA = "id long, t string, x double"


@pytest.fixture(scope="module")
def rows():
    return [(k, f"text {k}", k / 7) for k in range(3000)] + [(None, None, None), (None, "a", None), (5, "twin", 1.0), (5, "twin", 1.0)]


def written(spark, rows, path, ranges=audit.RANGES):
    audit.write_version(spark.createDataFrame(rows, SCHEMA).repartition(3), path, "id", ranges)
    return path


@pytest.mark.parametrize("ranges", [256, 40])
def test_planted_changes(spark, rows, tmp_path, ranges):
    """A lost row, a changed one, a lost copy, a row without a key: found as exceptAll finds them, out of few ranges."""
    after = [r for r in rows if r[0] != 77]
    after[after.index((1234, "text 1234", 1234 / 7))] = (1234, "text 1234 ", 1234 / 7)
    after.remove((5, "twin", 1.0))
    after.append((None, "a", 0.0))
    old, new = written(spark, rows, f"{tmp_path}/old", ranges), written(spark, after, f"{tmp_path}/new", ranges)
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA)
    want = [(*r, "old") for r in map(tuple, a.exceptAll(b).collect())] + [(*r, "new") for r in map(tuple, b.exceptAll(a).collect())]
    assert sorted(map(repr, map(tuple, audit.changes(spark, old, new, ranges).collect()))) == sorted(map(repr, want)) and len(want) == 5
    where, compared = audit.differing(spark, old, new, ranges)
    assert 2 <= len(where) <= 4
    if ranges == 256:
        assert compared < ranges
        read = spark.read.parquet(f"{old}/rows").where(F.col("_range").isin(where)).count()
        assert read < len(rows) / 10


def test_equal_versions(spark, rows, tmp_path):
    old, new = written(spark, rows, f"{tmp_path}/old"), written(spark, rows[::-1], f"{tmp_path}/new")
    assert audit.differing(spark, old, new) == ([], 1) and audit.changes(spark, old, new).collect() == []


def test_clashing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="_range"):
        audit.write_version(spark.createDataFrame([(1, 2)], "id long, _range int"), f"{tmp_path}/x", "id")


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("most", [500_000, 3])
def test_equal_rows_of_differing_ranges_stay(spark, tmp_path, monkeypatch, most):
    """Changes in every range: the rows that changed are dealt out whole, of the others digests alone."""
    monkeypatch.setattr(audit, "MOST_BROADCAST", most, raising=False)
    rng = random.Random(18)
    before = [(k, rng.randbytes(2_000).hex(), 0.0) for k in range(1_000)]
    after = [(k, t + "!" if k % 20 == 7 else t, -0.0 if k % 20 == 9 else x) for k, t, x in before]
    old, new = written(spark, before, f"{tmp_path}/old", 8), written(spark, after, f"{tmp_path}/new", 8)
    assert audit.differing(spark, old, new, 8)[0] == list(range(8))
    began = shuffled(spark)
    got = sorted((r.id, r.side, r.t) for r in audit.changes(spark, old, new, 8).collect())
    moved = shuffled(spark) - began
    assert got == sorted((k, side, t) for side, rows in (("old", before), ("new", after)) for k, t, _ in rows if k % 20 == 7)
    if most > 3:
        assert moved < sum(len(t) for _, t, _ in before)


def test_rows_that_differ_in_little(spark, tmp_path):
    """Microseconds, bytes that are no UTF-8, nulls and the names of nulls tell rows apart."""
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, at, "a", None, b"x"), (2, at, None, "b", b"x"), (3, at, "a:", "1:b", b"\xc3"), (4, None, "", None, None)]
    other = [(1, at.replace(microsecond=123457), "a", None, b"x"), (2, at, "b", None, b"x"), (3, at, "a:", "1:b", b"\xc4"), (4, None, None, "", None)]
    made = [spark.createDataFrame(x, "id long, at timestamp, t string, u string, raw binary").withColumn("raw", F.col("raw").cast("string")) for x in (rows, other)]
    for df, name in zip(made, ("old", "new"), strict=True):
        audit.write_version(df, f"{tmp_path}/{name}", "id", 4)
    got = audit.changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", 4)
    assert sorted((r.id, r.side) for r in got.select("id", "side").collect()) == sorted((k, side) for k in (1, 2, 3, 4) for side in ("old", "new"))
