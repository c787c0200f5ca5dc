"""WARC archives: pages written as compressed records, and a sequential reader of any such archive.

Writing. Records with equal payloads of at least LEAST bytes share one ``response``, that of the smallest page id; the others
are ``revisit`` records that name it and hold no payload. Each record is a gzip member of its own. A task writes files of
about FILE_BYTES under names of its own attempt, and only the files that a finished task reports are listed, so a task that
is run again, or twice, leaves no record twice. Files go to the shared folder through pyarrow's file systems.

Reading. A file is read front to back in pieces of READ_BYTES: each member is inflated as it arrives, headers up to the
empty line, then as many bytes as Content-Length says, whose digests are computed on the way. At most one payload is in
memory. Files are dealt to tasks by a list of paths.

A record that is cut off, badly framed, or that differs from its digests comes with a ``problem``; after a broken member
the rest of its file cannot be framed and is left out, which that ``problem`` says.

Odd input: null html counts as empty; null ids come after all others and are written as null; rows that repeat an id are records of their own,
the first of which by file order is the response; a null or odd url is kept in the header of the row, and the target URI has
its control and non-ASCII characters escaped; no row gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, materialise, numbered
from tidemark.session import ensure_checkpoint_dir

LEAST = 100  #: bytes of a payload that a revisit may stand for
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 18
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096  #: payload and records that a reader holds before it hands them on
TASKS = 10_000  #: greatest number of tasks of a read
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_LINES = (b"WARC/1.0", b"WARC/1.1")
LISTED = "path string, records long, bytes long"
FIELDS = {
    "path": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "refers_to": pa.string(),
    "row": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "problem": pa.string(),
}
RECORD = pa.schema(list(FIELDS.items()))
RECORD_DDL = "path string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, row string, payload binary, payload_bytes long, payload_digest string, problem string"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Spark's s3a scheme is s3 here."""
    path = path.replace("s3a://", "s3://", 1)
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def record(row: str, url: str | None, payload: bytes, size: int, digest: str, record_id: str, refers_to: str | None) -> bytes:
    """The response, or with ``refers_to`` the revisit, of a page whose payload is of ``size`` bytes. ``row`` is what the reader hands back."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Row", row), ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(headers + ([("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)] if refers_to else []), block)


class Archive:
    """Files of one task attempt, begun anew at FILE_BYTES."""

    def __init__(self, folder: str, limit: int):
        self.files, self.folder = store(folder)
        self.given, self.limit, self.out, self.done = folder.rstrip("/"), limit, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.name, self.records, self.size = self.files.open_output_stream(f"{self.folder}/{name}", compression=None), name, 0, 0
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.given}/{self.name}", self.records, self.size))
            self.out = None


def with_first(pages: DataFrame, key: str, html: str, place: str, digest: str, first: str) -> DataFrame:
    """``pages`` with the digest of each payload and, for those of at least LEAST bytes that several rows share, the ``first`` row as (key, place).

    Groups shrink to one row on the map side; only groups of several rows are joined back, and adaptive execution splits a hot one.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.withColumn(digest, F.sha2(payload, 256))
    heads = rows.where(F.octet_length(payload) >= LEAST).groupBy(digest).agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), F.col(place).alias("place"))).alias("_h"), F.count("*").alias("_n"))
    heads = heads.where("_n > 1").select(F.col(digest), F.struct("_h.key", "_h.place").alias(first))
    return rows.join(heads, digest, "left")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` and return the list of files (path, records, bytes).

    The header of a row holds its key and url, and the key of the response that a revisit stands for.
    """
    place, digest, first = (free_name(pages, x) for x in ("place", "digest", "first"))
    rows = with_first(numbered(pages.select(key, url, html), place), key, html, place, digest, first)
    other = F.col(first)["place"] != F.col(place)
    header = F.struct(F.col(key).alias("key"), F.col(url).alias("url"), F.when(other, F.col(first)["key"]).alias("of"))
    rows = rows.select(
        F.base64(F.to_json(header, {"ignoreNullFields": "false"}).cast("binary")), F.col(url).cast("string"), F.when(F.coalesce(other, F.lit(False)), F.lit("")).otherwise(F.coalesce(F.col(html), F.lit(""))),
        F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("long"), F.col(digest), F.col(place), F.when(other, F.col(first)["place"]),
    ).toDF("row", "url", "html", "size", "digest", "place", "of")
    space = uuid.uuid4()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, file_bytes)
        name = lambda n: f"<urn:uuid:{uuid.uuid5(space, str(n))}>"
        for batch in batches:
            for i in range(batch.num_rows):
                row, target, text, size, sha, n, of = (batch.column(c)[i].as_py() for c in range(7))
                archive.add(record("".join(row.split()), target, text.encode(), size, sha, name(n), None if of is None else name(of)))
        archive.close()
        yield pa.record_batch([list(c) for c in zip(*archive.done, strict=True)] or [[], [], []], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    files, inside = store(folder)
    files.create_dir(inside, recursive=True)
    return materialise(rows.mapInArrow(put, LISTED), "warc-files")


class Member:
    """A record being read: headers until the empty line, then the block, digested as it arrives."""

    def __init__(self, offset: int, keep: bool):
        self.offset, self.keep, self.head, self.headers, self.problem = offset, keep, b"", None, None
        self.left, self.tail, self.http, self.in_payload = 0, b"", b"", False
        self.payload, self.size, self.block_sha, self.payload_sha = bytearray(), 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *lines = self.head[:end].split(b"\r\n")
            self.headers = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}
            length = self.headers.get("content-length", "")
            if first not in FIRST_LINES or not length.isdigit():
                self.problem = "framing"
            self.left = int(length) if length.isdigit() else 0
            data, self.head = self.head[end + 4 :], b""
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.tail = (self.tail + rest)[:5]
        self.block_sha.update(block)
        if self.headers.get("content-type", "").startswith("application/http") and not self.in_payload:
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            self.in_payload, block, self.http = True, self.http[end + 4 :], self.http[:end]
        self.payload_sha.update(block)
        self.size += len(block)
        if self.keep:
            self.payload += block

    def trouble(self) -> str | None:
        if self.problem or self.headers is None or self.left:
            return self.problem or "cut off"
        if self.tail != b"\r\n\r\n":
            return "framing"
        checked = [("warc-block-digest", self.block_sha)] + [("warc-payload-digest", self.payload_sha)] * (self.headers.get("warc-type") != "revisit")
        given = [(self.headers.get(k, ""), sha.hexdigest()) for k, sha in checked]
        return "digest" if any(said.startswith("sha256:") and said.lower() != f"sha256:{is_so}" for said, is_so in given) else None

    def fields(self, path: str) -> dict:
        head = self.headers or {}
        revisit = head.get("warc-type") == "revisit"
        size, digest, row = self.size, self.payload_sha.hexdigest(), head.get("x-row")
        if revisit:  # holds no payload: length and digest are those of the record that it refers to
            lengths = [v.strip() for k, _, v in (line.partition(b":") for line in self.http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
            size = int(lengths[0]) if lengths and lengths[0].isdigit() else None
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        return {
            "path": path, "offset": self.offset, "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"), "row": base64.b64decode(row).decode() if row else None,
            "payload": bytes(self.payload) if self.keep and not revisit else None, "payload_bytes": size, "payload_digest": digest, "problem": self.trouble(),
        }


def records(path: str, keep: bool = True, piece: int = READ_BYTES) -> Iterator[dict]:
    """The records of a file in order, as dicts of FIELDS; without ``keep``, payloads are digested but not held."""
    files, inside = store(path)
    with files.open_input_stream(inside, compression=None) as source:
        at, data = 0, source.read(piece)
        while data:
            found, press = Member(at, keep), zlib.decompressobj(31)
            while not press.eof and found.problem is None:
                data = data or source.read(piece)
                if not data:
                    found.problem = "cut off"
                    break
                before = len(data)
                try:
                    found_text = press.decompress(data, 4 * piece)
                except zlib.error:
                    found.problem = "broken member: the rest of the file is left out"
                    break
                data = press.unused_data if press.eof else press.unconsumed_tail
                at += before - len(data)
                found.feed(found_text)
                if found.problem == "framing":  # not a record: its member is passed over
                    while not press.eof and (data := data or source.read(piece)):
                        before = len(data)
                        press.decompress(data, 4 * piece)
                        data = press.unused_data if press.eof else press.unconsumed_tail
                        at += before - len(data)
            yield found.fields(path)
            if not press.eof:
                return
            data = data or source.read(piece)


def read(files: DataFrame, path: str = "path", keep: bool = True) -> DataFrame:
    """The records of the files listed in ``files``, a task for a file or a few."""

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in records(name, keep):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    names = files.select(F.col(path).cast("string").alias("path"))
    return names.repartition(max(1, min(names.count(), TASKS))).mapInArrow(read_files, RECORD_DDL)


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the archives in a folder that Spark can list; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(pattern).select("path", F.col("length").alias("bytes"))


def stored(pages: DataFrame, key: str = "page_id", keep: bool = True, **options) -> DataFrame:
    """``pages`` written to the shared folder as archives and read back: (key, url, refers_to_key) and RECORD but for ``row``."""
    files = write(pages, f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}", key=key, **options)
    kind = pages.schema[key].dataType.simpleString()
    rows = read(files, keep=keep).withColumn("row", F.from_json("row", f"key {kind}, url string, of {kind}"))
    return rows.select(F.col("row.key").alias("key"), F.col("row.url").alias("url"), F.col("row.of").alias("refers_to_key"), *[c for c in RECORD.names if c != "row"])
