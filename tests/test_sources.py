import bz2
import io
import os
import resource
import tarfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

from inkmill.sources import archives, files, publish


def record(downloads=None, rights=None):
    return ("é\n" + (f'<pgterms:downloads x="1">{downloads}</pgterms:downloads>' if downloads is not None else "") + (f"<dcterms:rights>{rights}</dcterms:rights>" if rights is not None else "")).encode()


def made(path, members, mode):
    with tarfile.open(path, mode) as tar:
        folder = tarfile.TarInfo("cache")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


@pytest.fixture
def three(tmp_path):
    name = archives.RECORD_NAME.format
    made(tmp_path / "a.tar.bz2", [(name(1), record(5, "Public")), (name(2), record(None, "Public")), ("cache/epub/1/pg1.txt", b"\xff\xfe"), ("cache/epub/3/pg4.rdf", record(9, "no"))], "w:bz2")
    made(tmp_path / "b.tar.gz", [(name(7), record(70)), (name("x1"), record(3, "R & D"))], "w:gz")
    made(tmp_path / "c.tar", [(name(8), b""), (name(12), record(12, ""))], "w")
    made(tmp_path / "_staged.tar", [(name(99), record(1))], "w")
    return str(tmp_path)


@pytest.mark.parametrize("most", [50_000, 1])
def test_wanted_records(spark, three, monkeypatch, most):
    monkeypatch.setattr(archives, "MOST_PUSHED", most)
    wanted = spark.createDataFrame([("1",), ("2",), ("7",), ("x1",), ("12",), ("3",), ("99",), (None,), ("1",)], "book_id string")
    got = archives.catalog_records(spark, three, wanted).collect()
    assert sorted(map(tuple, got)) == [("1", 5, "Public"), ("12", 12, ""), ("2", 0, "Public"), ("7", 70, ""), ("x1", 3, "R & D")]
    assert archives.catalog_records(spark, three, wanted.limit(0)).collect() == []


def test_members_and_partitions(spark, three):
    df = archives.members(spark, three)
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 8 and df.where("size = 0").count() == 1
    assert [r.name for r in archives.members(spark, f"{three}/c.tar, {three}/b.tar.gz").where(F.col("name").startswith("cache/epub/1")).collect()] == ["cache/epub/12/pg12.rdf"]
    with pytest.raises(PySparkException):
        archives.members(spark, f"{three}/none.tar").collect()


def test_filters_that_the_source_takes():
    r = archives.MembersReader("")
    rest = list(r.pushFilters([EqualTo(("name",), "a.rdf"), In(("name",), ("a.rdf", "b")), StringStartsWith(("name",), "a"), StringEndsWith(("name",), ".rdf"), GreaterThan(("name",), "a"), EqualTo(("size",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan, EqualTo] and r.wanted("a.rdf") and not r.wanted("b")


def test_unwanted_members_are_never_taken(three, monkeypatch):
    taken = []
    real = tarfile.TarFile.extractfile
    monkeypatch.setattr(tarfile.TarFile, "extractfile", lambda self, m: taken.append(m.name) or real(self, m))
    r = archives.MembersReader(three)
    list(r.pushFilters([EqualTo(("name",), "cache/epub/2/pg2.rdf")]))
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert taken == ["cache/epub/2/pg2.rdf"] and [x["name"] for x in rows] == taken


def test_memory_does_not_grow_with_the_archive(tmp_path):
    """20 MB and 200 MB of members, of which one is wanted."""
    peaks = []
    for mb in (20, 200):
        block = bytes(1 << 20)
        with bz2.open(tmp_path / f"{mb}.tar.bz2", "w", compresslevel=1) as f, tarfile.open(fileobj=f, mode="w|") as tar:
            for k in range(mb):
                info = tarfile.TarInfo(f"m{k}")
                info.size = len(block)
                tar.addfile(info, io.BytesIO(block))
        r = archives.MembersReader(str(tmp_path / f"{mb}.tar.bz2"))
        list(r.pushFilters([EqualTo(("name",), f"m{mb - 1}")]))
        assert [b.num_rows for p in r.partitions() for b in r.read(p)] == [1]
        peaks.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
    assert peaks[1] - peaks[0] < 40


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"f/{k}", bytes([k % 256]) * k) for k in range(300)]
    path = str(tmp_path / "out")
    archives.write_members(spark.createDataFrame(rows, "name string, content binary").repartition(3), path)
    assert sorted((r.name, bytes(r.content)) for r in archives.members(spark, path).collect()) == sorted(rows)
    assert not [n for n in os.listdir(path) if n.startswith("_staged")]
    with pytest.raises(PySparkException):
        archives.write_members(spark.createDataFrame(rows[:1], "name string, content binary"), path)
    assert archives.members(spark, path).count() == 300


def test_a_failed_write_leaves_nothing(tmp_path):
    w = archives.MembersWriter(str(tmp_path / "x"), False)

    def batches():
        yield pa.RecordBatch.from_pydict({"name": ["a"], "content": [b"1"]})
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        w.write(batches())
    w.abort([])
    assert archives.listed(str(tmp_path / "x")) == []


def test_publication(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        publish.published(spark, path)
    old, new = spark.range(10), spark.range(5).withColumn("id", F.col("id") + 100)
    publish.publish(old, path)
    before = publish.published(spark, path)
    # a write that stops before, and one that stops after its rows are there, leave the old version
    failing = spark.range(8).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("stopped")).cast("long")).alias("id"))
    with pytest.raises(PySparkException):
        publish.publish(failing, path)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(publish, "replace_file", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        publish.publish(new, path)
    assert sorted(r.id for r in publish.published(spark, path, verify=True).collect()) == list(range(10))
    publish.publish(new, path)
    assert sorted(r.id for r in publish.published(spark, path, verify=True).collect()) == list(range(100, 105))
    assert before.count() == 10  # who reads the old version still can
    assert publish.forget(spark, path) == 3 and publish.published(spark, path).count() == 5


def test_a_changed_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    record = publish.publish(spark.range(4), path)
    spark.range(1).write.mode("append").parquet(f"{path}/{record['version']}")
    assert publish.published(spark, path).count() == 5
    with pytest.raises(ValueError, match="has changed"):
        publish.published(spark, path, verify=True)


def test_content_is_of_rows_in_any_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    assert publish.content(a) == publish.content(a.repartition(3).select("v", "k")) != publish.content(a.distinct())
    assert publish.content(a.limit(0)) == {"rows": 0, "digest": "0:0:0:0"}


def test_text_formats(spark, tmp_path):
    """JSON lines, JSON documents, CSV with quotes and newlines, whole texts without marks, records with their file."""
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "é"}\n{"k": 2, "t": null}\n')
    (tmp_path / "d.json").write_text('{"a":\n [1, 2]}')
    (tmp_path / "c.csv").write_text('Text#,Title\n1,"say ""hi"", she\nsaid"\n2,x\n')
    (tmp_path / "t.txt").write_bytes("﻿one\r\ntwo".encode())
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "k long, t string").collect()] == [(1, "é"), (2, None)]
    assert files.json_document(spark, str(tmp_path / "d.json")).first().a == [1, 2]
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "c.csv")).collect()] == [("1", 'say "hi", she\nsaid'), ("2", "x")]
    assert files.whole_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"
    assert files.records(spark, str(tmp_path / "*.json")).first().path.endswith("d.json")
