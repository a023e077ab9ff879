"""WARC archives as a PySpark Python data source, read and write.

Writer: every task writes its records to archive files of bounded size in the
folder given as ``path``, under names that no other attempt uses; the commit
writes a manifest of the files of the tasks that counted, so files of lost or
repeated attempts are never read. ``append`` adds to the manifest's files;
``overwrite`` deletes them once the new manifest is there.

Reader: the manifest (or the folder's listing) gives the files; they are packed
into partitions by size. Comparisons of the header columns with constants (=, IN,
<, <=, >, >=, prefixes, IS NULL and IS NOT NULL) are pushed into the reader. Headers
are parsed first; the payload of a record that no filter wants, or of any record
when ``payload=false``, is skipped (by seeking in plain archives, by discarding
inflated bytes in ``.gz``) and never decoded.

Archives are reached by pyarrow's file systems, so shared stores work as well as
a shared folder.

Defined results of ``archive_pages``: a null html is an empty payload; rows that
repeat a page_id are one page each and may be ``response`` together; rows with a
null page_id are written as ``response`` with an empty id; an empty table writes
no record; other columns are ignored. A payload is held whole in memory, some four
times while it is written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import materialise, shared_path, sized

MANIFEST = "_manifest.json"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, http_length bigint, payload binary"
FILE_BYTES = 64 << 20  # an archive is closed once it holds more
PART_BYTES = 8 << 20  # archives read by one task, unless one alone is larger
CHUNK = 1 << 20
BATCH_BYTES, ROW_BYTES = 4 << 20, 500  # of records sent to Spark at once, unless one is longer; headers of one
DATE = "2000-01-01T00:00:00Z"  # records of tables have no crawl date


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    if not urlparse(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def record(record_type: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """The bytes of one response or revisit record.

    Both carry the HTTP head with the length and the digest of the full payload;
    only a response carries the payload.
    """
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def listed(fs, root: str) -> list[tuple[str, int]] | None:
    """(name, size) of the manifest's archives; none without a manifest."""
    from pyarrow import fs as pafs

    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
        return [tuple(x) for x in json.loads(f.read())]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("maxfilebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        try:
            for batch in iterator:
                columns = [batch.column(k) for k in ("record_type", "record_id", "target_uri", "payload", "refers_to")]
                for row in zip(*columns, strict=True):
                    kind, rid, uri, payload, refers = (x.as_py() for x in row)
                    data = record(kind, rid or "", uri or "", payload or b"", refers)
                    if self.gzip:  # one member a record, as archives have it
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                        out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    out.write(data)
                    size += len(data)
                    if size >= self.limit:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        before = listed(fs, root) or []
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files if self.overwrite else before + files).encode())
        if self.overwrite:
            for name, _ in before:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class Stream:
    """Bytes of an archive, inflated if need be; reads lines, reads and skips lengths."""

    def __init__(self, raw, gzip: bool):
        self.raw, self.gzip, self.buffer, self.rest = raw, gzip, b"", b""
        self.z = zlib.decompressobj(31) if gzip else None

    def fill(self) -> bool:
        if not self.gzip:
            data = self.raw.read(CHUNK)
            self.buffer += data
            return bool(data)
        while True:
            data = self.rest or self.raw.read(CHUNK)
            self.rest = b""
            if not data:
                return False
            made = self.z.decompress(data, CHUNK)
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.z.unconsumed_tail
            if made:
                self.buffer += made
                return True

    def head(self) -> list[bytes] | None:
        """Lines up to the next empty one; none at the end."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if self.buffer or not self.fill():
                break
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                return None
        lines, self.buffer = self.buffer[:at].split(b"\r\n"), self.buffer[at + 4 :]
        return lines

    def http(self, n: int) -> tuple[bytes, int]:
        """(HTTP head, bytes read) of a block of ``n`` bytes; all of it if no empty line ends the head."""
        while (at := self.buffer.find(b"\r\n\r\n", 0, n)) < 0 and len(self.buffer) < n:
            if not self.fill():
                raise EOFError("archive ends within a record")
        stop = n if at < 0 else at + 4
        head, self.buffer = self.buffer[:stop], self.buffer[stop:]
        return head, stop

    def read(self, n: int) -> bytes:
        parts = io.BytesIO()
        while n > 0:
            if not self.buffer and not self.fill():
                raise EOFError("archive ends within a record")
            parts.write(self.buffer[:n])
            took = min(n, len(self.buffer))
            self.buffer, n = self.buffer[took:], n - took
        return parts.getvalue()

    def skip(self, n: int) -> None:
        took = min(n, len(self.buffer))
        self.buffer, n = self.buffer[took:], n - took
        if n and not self.gzip:
            self.raw.seek(n, 1)
            return
        while n > 0:
            if not self.fill():
                raise EOFError("archive ends within a record")
            took = min(n, len(self.buffer))
            self.buffer, n = self.buffer[took:], n - took


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Records, in the order of ``SCHEMA``, as one Arrow batch."""
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


HEADER = ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to")
#: Tests of a header's value, which is not null, against a constant; text is ordered by its bytes.
TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x.encode() > v.encode(),
    GreaterThanOrEqual: lambda x, v: x.encode() >= v.encode(),
    LessThan: lambda x, v: x.encode() < v.encode(),
    LessThanOrEqual: lambda x, v: x.encode() <= v.encode(),
    StringStartsWith: lambda x, v: x.startswith(v),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true") != "false"
        self.part_bytes = int(options.get("partitionbytes", PART_BYTES))
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            of = getattr(f, "attribute", None)
            if of and len(of) == 1 and of[0] in HEADER and (type(f) in (IsNull, IsNotNull) or type(f) in TESTS and f.value is not None):
                self.wanted.append(f)
            else:
                yield f

    def wants(self, header: dict) -> bool:
        """All pushed filters hold of a record's header columns."""
        for f in self.wanted:
            x = header[f.attribute[0]]
            if isinstance(f, IsNull | IsNotNull):
                if (x is None) != isinstance(f, IsNull):
                    return False
            elif x is None or not TESTS[type(f)](x, f.value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        if (files := listed(fs, root)) is None:
            found = fs.get_file_info(pafs.FileSelector(root))
            files = [(x.base_name, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        parts, size = [], 0
        for name, n in sorted(files):
            if not parts or size + n > self.part_bytes:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [Archives(p) for p in parts] or [Archives([])]

    def records(self, stream: Stream) -> Iterator[tuple]:
        while (lines := stream.head()) is not None:
            h = {}
            for line in lines[1:]:
                k, _, v = line.decode("utf-8", "replace").partition(":")
                h[k.strip().lower()] = v.strip()
            length, kind = int(h.get("content-length", 0)), h.get("warc-type")
            ids = [(h.get(k) or "").strip("<>").removeprefix("urn:page:") or None for k in ("warc-record-id", "warc-refers-to")]
            digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
            header = dict(zip(HEADER, (ids[0], kind, h.get("warc-target-uri"), h.get("warc-date"), digest, ids[1]), strict=True))
            if not self.wants(header):
                stream.skip(length)
                continue
            http, body, left = None, None, length
            if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
                head, before = stream.http(length)
                left -= before
                for line in head.split(b"\r\n"):
                    if line.lower().startswith(b"content-length:"):
                        http = int(line.split(b":")[1])
            if self.payload and kind != "revisit":
                body = stream.read(left)
            else:
                stream.skip(left)
            yield *header.values(), http, body

    def read(self, partition: Archives):
        fs, root = filesystem(self.path)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as raw:
                for row in self.records(Stream(raw, name.endswith(".gz"))):
                    rows.append(row)
                    size += ROW_BYTES + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it push filters down, which stays on."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of pages: record_type, record_id, target_uri, payload, refers_to.

    Of pages with equal payloads of at least ``min_bytes``, the one with the
    largest id is the response. Payloads are grouped by digest in narrow rows
    (a partial maximum first, so a payload that a third of the pages share is
    one row a partition); only the ids of revisits meet the payloads again.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keys = p.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(
        F.col("n") >= min_bytes
    )
    shared = (
        keys.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
        .where("least < refers_to")
        .select("digest", "refers_to")
    )
    revisits = materialise(
        keys.join(sized(materialise(shared, "shared")), "digest")
        .where("page_id < refers_to")
        .select(F.col("page_id").alias("_page"), "refers_to")
        .distinct(),
        "revisits",
    )
    return p.join(sized(revisits), p["page_id"] == revisits["_page"], "left").select(
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("page_id").cast("string").alias("record_id"),
        F.col("url").alias("target_uri"),
        "payload",
        F.col("refers_to").cast("string").alias("refers_to"),
    )


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> str:
    """Write the pages as archives in ``path`` and return it."""
    register(pages.sparkSession)
    records = records_of(pages, min_bytes)
    records.write.format("warc").option("compression", compression).mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records in ``path``; ``payload=False`` leaves payloads null and unread."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _base32(hexed: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal digits."""
    tens = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*tens), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records in ``path``.

    Size and digest of a response are those of its payload as read; a revisit
    has no payload and gives what its headers say.
    """

    def rows(records: DataFrame, size: Column, digest: Column) -> DataFrame:
        return records.select(
            F.col("record_id").cast("bigint").alias("page_id"),
            size.cast("bigint").alias("payload_bytes"),
            digest.alias("payload_digest"),
            "record_type",
            F.col("refers_to").cast("bigint").alias("refers_to"),
        )

    full = read_archives(spark, path).where("record_type = 'response'")
    heads = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    return rows(full, F.octet_length("payload"), _base32(F.sha1("payload"))).unionAll(
        rows(heads, F.col("http_length"), F.col("payload_digest"))
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Digest rows of the pages as they are in archives written to the shared folder."""
    spark = pages.sparkSession
    return digests(spark, archive_pages(pages, shared_path(spark, "warc"), min_bytes))
