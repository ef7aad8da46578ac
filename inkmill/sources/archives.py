"""Tar archives as a data source: a row for each member, archives dealt out over tasks and read as streams.

An archive is one partition. Its members are read one after the other and only those that the pushed filters
on their names let through are taken from the stream; the others are skipped, neither kept nor decoded. So a
task needs memory for one batch and the largest member it takes, however large the archive. A stream has no
places to start at, so a single archive is not split: corpora of many archives are what spreads.

Paths are those of pyarrow's file systems (local and mounted folders, object stores, HDFS with its library).
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "archive string, name string, size long, content binary"
#: Bytes of members to a batch; wanted ids up to which their names are pushed to the source.
BATCH_BYTES, MOST_PUSHED = 4 << 20, 50_000
SUFFIXES = (".tar", ".tar.bz2", ".tar.gz", ".tgz")


def _opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    raw = fs.open_input_stream(path, compression=None)
    if uri.endswith(".bz2"):
        return bz2.BZ2File(raw)
    return gzip.GzipFile(fileobj=raw) if uri.endswith((".gz", ".tgz")) else raw


def listed(paths: str) -> list[str]:
    """The archives of comma-separated files and folders, by name; what begins with _ or . is none."""
    out = []
    for uri in filter(None, (p.strip() for p in paths.split(","))):
        fs, path = pafs.FileSystem.from_uri(uri)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == pafs.FileType.File:
            out.append(uri)
            continue
        names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File]
        out += [f"{uri.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(SUFFIXES) and n[0] not in "_."]
    return out


@dataclass
class Archive(InputPartition):
    uri: str


class MembersReader(DataSourceReader):
    def __init__(self, paths: str):
        self.paths, self.names, self.starts, self.ends = paths, None, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("name",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                these = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.names = these if self.names is None else self.names & these
            elif isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Archive(uri) for uri in listed(self.paths)]

    def wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(map(name.startswith, self.starts)) and all(map(name.endswith, self.ends))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Archive):  # a folder without archives still gets one task
            return
        names, contents, held = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.uri] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(map(len, contents), pa.int64()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "name", "size", "content"])

        with _opened(partition.uri) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for member in tar:
                tar.members.clear()  # the library keeps all it has seen
                if member.isfile() and self.wanted(member.name):
                    names.append(member.name)
                    contents.append(tar.extractfile(member).read())
                    held += len(contents[-1])
                    if held >= BATCH_BYTES:
                        yield batch()
                        names, contents, held = [], [], 0
        if names:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str
    members: int


class MembersWriter(DataSourceArrowWriter):
    """Each task writes an archive into a staged folder; they move to the path when all tasks are done, and a list of them comes last."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.staged, self.overwrite = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, at = pafs.FileSystem.from_uri(self.path)
        name, n = f"part-{uuid.uuid4().hex}.tar.bz2", 0
        fs.create_dir(f"{at}/{self.staged}")
        with fs.open_output_stream(f"{at}/{self.staged}/{name}", compression=None) as raw, bz2.BZ2File(raw, "w") as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for b in batches:
                for member, content in zip(b.column("name").to_pylist(), b.column("content").cast(pa.binary()).to_pylist(), strict=True):
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                    n += 1
                    tar.members.clear()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = pafs.FileSystem.from_uri(self.path)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File]
        if before and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        done = sorted((m.name, m.members) for m in messages if m and m.members)
        for name, _ in done:
            fs.move(f"{at}/{self.staged}/{name}", f"{at}/{name}")
        for old in before:
            fs.delete_file(old)
        with fs.open_output_stream(f"{at}/_archives.json") as f:
            f.write(json.dumps(dict(done), sort_keys=True).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{at}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staged}")


class Members(DataSource):
    """spark.read.format("tar_members").option("path", ...): archive, name, size, content of each file in the archives; df(name, content).write.format("tar_members")."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> MembersWriter:
        return MembersWriter(self.options["path"], overwrite)


def members(spark: SparkSession, paths: str) -> DataFrame:
    """SCHEMA, a row for each file in the archives. Filters on name are pushed down: equal, in, starts and ends with."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Members)
    return spark.read.format("tar_members").option("path", paths).load()


def write_members(df: DataFrame, path: str) -> None:
    """df(name, content) as archives, one a partition that has rows; refuses to overwrite."""
    df.sparkSession.dataSource.register(Members)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format("tar_members").option("path", path).mode("append").save()


#: Where a record stands in a catalog's archive, and what is read of it.
RECORD_NAME = "cache/epub/{0}/pg{0}.rdf"
DOWNLOADS, RIGHTS = r"<pgterms:downloads[^>]*>(\d+)</pgterms:downloads>", r"<dcterms:rights>([^<]*)</dcterms:rights>"


def catalog_records(spark: SparkSession, paths: str, wanted: DataFrame) -> DataFrame:
    """(book_id, downloads, rights) of the wanted(book_id) records in the archives; 0 and '' where a record has none.

    The names of up to MOST_PUSHED wanted records are pushed to the source, so no other member is taken from its
    stream; of more, all records are, and those that aren't wanted are left out by a join before they are decoded.
    """
    found = members(spark, paths)
    ids = wanted.select(F.col("book_id").cast("string").alias("book_id")).where("book_id is not null").distinct()
    some = [r.book_id for r in ids.limit(MOST_PUSHED + 1).collect()]
    if len(some) <= MOST_PUSHED:
        found = found.where(F.col("name").isin([RECORD_NAME.format(i) for i in some])) if some else found.limit(0)
    else:
        found = found.where(F.endswith("name", F.lit(".rdf")))
    found = found.withColumn("book_id", F.regexp_extract("name", "^" + RECORD_NAME.replace("{0}/", "([^/]+)/").replace("{0}", r"\1").replace(".rdf", r"\.rdf$"), 1)).join(ids, "book_id", "left_semi")
    text = found.select("book_id", F.decode("content", "UTF-8").alias("text"))
    return text.select("book_id", F.coalesce(F.regexp_extract("text", DOWNLOADS, 1).try_cast("long"), F.lit(0)).alias("downloads"), F.regexp_extract("text", RIGHTS, 1).alias("rights"))
