"""WARC archives with Zstandard: a writer that shares a dictionary, and a reader that validates.

An archive starts with a skippable frame (magic 0x184D2A5D) whose payload is the dictionary, itself one
Zstandard frame or bare; then comes one frame per record. Archives travel as rows (name, content), so
that Spark's own writer commits them whole or not at all, on any file system; read_archives() also
takes files, by binaryFile. An archive is closed at ARCHIVE_BYTES, so that no row grows with the input.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import only, small_enough, table, written

#: Fixed values of the format.
SKIPPABLE_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, DICT_BYTES, LEVEL = 4 << 20, 16 << 10, 3
RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary, error string"
#: Rows of a payload over which it is told to all tasks; revisits up to which they are broadcast.
HOT, MOST_BROADCAST = 100_000, 200_000
_DATE = "2024-01-01T00:00:00Z"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id, digest: str, nth: int) -> str:
    """A record's id: the page's, its payload's digest, and which of the records alike in both it is. A page without an id has none here either."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{nth}>"


def record(page_id, url, payload: bytes, digest: str, full_bytes: int, revisit: bool, refers_to=None, nth: int = 1) -> bytes:
    """One record. A revisit has no block of its own; its headers tell the payload's digest and length and the page of the response meant."""
    block = b"" if revisit else payload
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest, nth)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{bare_digest(block)}", f"X-Payload-Length: {full_bytes}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest, 1)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of the records; its dictionary is raw content from the first of them."""
    raw = b"".join(r[:2048] for r in records[:16])[:DICT_BYTES]
    held = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    shared = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True) if raw else zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(held)), held, *[shared.compress(r) for r in records]])


def frames(content: bytes) -> Iterator[bytes]:
    """Each frame of an archive, decoded alone with the archive's dictionary. ValueError if it is cut or has bytes that are no frame."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        held = content[8 : 8 + size]
        if len(held) < size:
            raise ValueError("the dictionary's frame is cut")
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        dictionary = zstandard.ZstdCompressionDict(held) if held else None
        at = 8 + size
    while at < len(content):
        if content[at : at + 4] != ZSTD_MAGIC:
            raise ValueError(f"no frame starts at byte {at}")
        size = _length(content, at)
        one = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = one.decompress(content[at : at + size])
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut")
        yield out
        at += size


def _length(content: bytes, at: int) -> int:
    """Bytes of the frame at `at`, by its header and block headers."""
    flags = content[at + 4]
    single = flags >> 5 & 1
    size = 4 + 1 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = content[at + size : at + size + 3]
        if len(head) < 3:
            raise ValueError(f"the frame at byte {at} is cut")
        head = int.from_bytes(head, "little")
        last, kind = bool(head & 1), head >> 1 & 3
        size += 3 + (1 if kind == 1 else head >> 3)
    size += 4 * (flags >> 2 & 1)
    if at + size > len(content):
        raise ValueError(f"the frame at byte {at} is cut")
    return size


def parse(raw: bytes) -> dict:
    """The fields of RECORD; error tells what doesn't hold (version, needed headers, lengths, digests), else null."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    page = lambda x: number((x or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0])
    length = number(fields.get("content-length"))
    block = rest[: length or 0]
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    wrong = None
    if not mark or first != VERSION:
        wrong = "no WARC/1.1 header"
    elif missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]:
        wrong = f"no {missing[0]}"
    elif length is None or length < 0 or len(block) != length or rest[length:] != b"\r\n\r\n":
        wrong = "Content-Length does not fit"
    elif "warc-block-digest" in fields and bare_digest(block) != fields["warc-block-digest"].removeprefix("sha1:"):
        wrong = "block digest does not fit"
    elif kind == "response" and digest and bare_digest(block) != digest:
        wrong = "payload digest does not fit"
    elif kind == "revisit" and not fields.get("warc-refers-to"):
        wrong = "a revisit refers to nothing"
    return {
        "page_id": page(fields.get("warc-record-id")), "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload_digest": digest or None,
        "payload_bytes": number(fields.get("x-payload-length", fields.get("content-length"))), "url": fields.get("warc-target-uri"), "payload": block, "error": wrong,
    }


def _write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in it:
        for page_id, url, html, digest, copies, is_response, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            payload = html or b""
            for k in range(copies):  # of rows alike in id, address and payload, the first is the response
                first = is_response and not k
                held.append(record(page_id, url, payload, digest, len(payload), not first, None if first else refers_to, k + 1))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(held)
                    held, size = [], 0
    if held:
        yield _archive(held)


def _archive(records: list[bytes]) -> pa.RecordBatch:
    content = pack(records)
    return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.zst"]), pa.array([content], pa.binary())], names=["name", "content"])


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in RECORD.split(", "))])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    for arrow in it:
        for content in arrow.column(0).to_pylist():
            rows, size = [], 0
            for raw in frames(content or b""):
                rows.append(parse(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def revisits(ids: DataFrame) -> DataFrame:
    """(key, response): the distinct rows of ids(key, page_id, url, sha, n) that are no response, and the page_id of theirs.

    Of equal payloads the largest page_id is the response (rows without an id come last; of equal ids, the
    last address). A payload that occurs on more than HOT rows is told to all tasks: there are at most rows / HOT.
    """
    top = F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "url", "key")).alias("top")
    many = written(ids.groupBy("sha").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), top).where("keys > 1").select("sha", "rows", F.col("top.page_id").alias("response"), F.col("top.key").alias("top_key")), "payloads")
    hot = many.where(F.col("rows") > HOT).drop("rows")
    told = ids.join(F.broadcast(hot), "sha")
    rest = ids.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(many.where(F.col("rows") <= HOT).drop("rows"), "sha")
    return told.select("key", "top_key", "response").unionByName(rest.select("key", "top_key", "response")).where("key <> top_key").drop("top_key")


def b32(sha_hex) -> F.Column:
    """Base32 of 20 bytes given as hexadecimal: eight times five bits from each of four groups of ten digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(sha_hex, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*[F.substring(F.lit(letters), 1, 32).substr((F.shiftright(g, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for g in groups for k in range(8)])


def write_archives(pages: DataFrame) -> DataFrame:
    """(name, content): the archives of pages(page_id, url, html), as a table in the shared folder; a record for each row.

    Null html is an empty payload. Rows are told apart by id, address and payload, so pages that share an id,
    or have none, keep their own payloads; rows alike in all three are records of their own, of which one can
    be the response. An empty table gives no archives.
    """
    pages = only(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit("")).cast("binary")
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(" "), F.col("sha"), F.coalesce(F.concat(F.lit(" "), "url"), F.lit("")))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha")).withColumn("key", key)
    ids = written(rows.groupBy("key", "page_id", "url", "sha").agg(F.count("*").alias("n")), "digests")
    others = written(revisits(ids), "revisits")
    # copies meet before they travel; payloads are shuffled once
    whole = rows.groupBy("key").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("html").alias("html"), F.first("sha").alias("sha"), F.count("*").alias("n"))
    others = others.withColumn("revisit", F.lit(True))
    whole = whole.join(F.broadcast(others) if small_enough(others, MOST_BROADCAST) else others, "key", "left")
    # what repeats a response's row refers to it
    rows = whole.select("page_id", "url", "html", b32(F.col("sha")).alias("digest"), "n", F.col("revisit").isNull().alias("is_response"), F.when(F.col("revisit"), F.col("response")).otherwise(F.col("page_id")).alias("refers_to"))
    return written(rows.mapInArrow(_write, "name string, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row of RECORD for each record of archives(content); a record that isn't valid has error. Null and empty archives have none."""
    return archives.select("content").mapInArrow(_read, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.zst files."""
    return read_archives(spark.read.format("binaryFile").load(path).select("content"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(table(spark, sf_dir, "pages")))
    checked = found.withColumn("ok", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("record "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")), F.lit(": "), F.col("error")))).otherwise(F.lit(True)))
    return checked.where("ok").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(p.html), {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * k}) & 31)::INT + 1, 1)" for g in range(4) for k in range(8)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM p
"""
