"""WARC: pages to archives and back.

Each record is a gzip member of its own.  The writer packs records into archive files of bounded size below the shared
scratch folder; a task names its files by chance and reports them, so files of a lost attempt are never read.  The
reader goes through an archive once: it inflates member by member from small blocks, frames the content by
Content-Length, and verifies block and payload digests, holding one record at a time.

Of rows with equal payloads of at least ``least_bytes`` the one with the largest page_id is the response; the others
are revisit records that refer to it and carry no payload, only its digest and length.  Which payloads repeat is found
from their digests; the payloads stay where they are unless more of them repeat than may be broadcast.

A target URI has no blanks, controls or characters beyond ASCII: they are percent-encoded, and a url that is changed by
that is kept whole in a field of its own, so that every url comes back as it was.

Defined results: null html is an empty payload; rows with null page_id revisit the largest id of their payload, or are
responses if there is none; rows that share the largest page_id are all responses; a null url has no target URI and comes
back null; a very long payload is one record, which is held in memory whole; columns of ``pages`` other than the three
named are not looked at; an empty table gives no archive and an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import materialize, quoted, scratch_dir

ARCHIVE_BYTES = 32 << 20
BLOCK = 1 << 16
LEVEL = 4
#: Payloads that repeat, at most so many, are told to all tasks; beyond that rows are shuffled to meet them.
BROADCAST_ROWS = 200_000
#: What stands in a target URI as it is, and in the field that keeps an odd url.
_PLAIN = "".join(c for c in string.printable if c.isprintable() and c != " ")
_KEPT = _PLAIN.replace("%", "")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut short, framed wrongly or of another digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *_uri_fields(url),
        *([] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _uri_fields(url: str | None) -> list[tuple[str, str]]:
    if url is None:
        return []
    plain = quote(url, safe=_PLAIN)
    return [("WARC-Target-URI", plain), *([] if plain == url else [("X-Source-Url", quote(url, safe=_KEPT))])]


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "<urn:page:>")[10:-1]
        return int(value) if value else None

    def url(self) -> str | None:
        kept = self.headers.get("X-Source-Url")
        return self.headers.get("WARC-Target-URI") if kept is None else unquote(kept)


class WarcReader:
    """Records of an archive in order, from a stream that is read once."""

    def __init__(self, stream: BinaryIO, block: int = BLOCK) -> None:
        self._stream, self._block, self._raw = stream, block, b""

    def __iter__(self) -> Iterator[Record]:
        while self._raw or self._more():
            yield self._record()

    def _more(self) -> bool:
        self._raw = bytes(self._stream.read(self._block))
        return bool(self._raw)

    def _record(self) -> Record:
        self._inflate, self._plain = zlib.decompressobj(31), bytearray()
        head = self._upto(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        headers = _fields(lines)
        size = int(headers["Content-Length"])
        body = self._take(size)
        if self._take(4) != b"\r\n\r\n":
            raise WarcError("the content is longer than its Content-Length")
        while not self._inflate.eof:
            if not self._feed():
                raise WarcError("the archive ends inside a member")
        if self._plain:
            raise WarcError("a member holds more than a record")
        self._raw = self._inflate.unused_data
        _verify(headers.get("WARC-Block-Digest"), body, "block")
        http, _, payload = body.partition(b"\r\n\r\n")
        if headers.get("WARC-Type") == "response":
            _verify(headers.get("WARC-Payload-Digest"), payload, "payload")
        return Record(headers, _fields(http.decode("latin-1").split("\r\n")[1:]), payload)

    def _feed(self) -> bool:
        """Inflate one more block; false at the stream's end."""
        if self._inflate.eof or not (self._raw or self._more()):
            return False
        self._plain += self._inflate.decompress(self._raw)
        self._raw = b""
        return True

    def _upto(self, mark: bytes) -> bytes:
        while (at := self._plain.find(mark)) < 0:
            if not self._feed():
                raise WarcError("the archive ends inside a header")
        out = bytes(self._plain[:at])
        del self._plain[: at + len(mark)]
        return out

    def _take(self, n: int) -> bytes:
        while len(self._plain) < n:
            if not self._feed():
                raise WarcError("the archive ends inside a record")
        out = bytes(self._plain[:n])
        del self._plain[:n]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _verify(named: str | None, data: bytes, what: str) -> None:
    if named and named != f"sha1:{base32_sha1(data)}":
        raise WarcError(f"the {what} digest is not {named}")


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path in it; Spark's names of S3 are Arrow's ``s3``."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", folder))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Write all rows as WARC files below ``folder`` (a URI that every executor reaches); a table of (path, n_records)."""
    rows = pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url"), F.coalesce(quoted(html), F.lit("")).cast("binary").alias("payload"))
    slim = rows.where(F.length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha1"))
    same = slim.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = materialize(same.where("n > 1").drop("n"), "same-payload")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    told = rows.withColumn("sha1", F.sha1("payload")).join(same, "sha1", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        for b in batches:
            for pid, link, payload, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = record(pid, link, payload, first)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield _row(path, n)
                    out = None
        if out is not None:
            out.close()
            yield _row(path, n)

    return materialize(told.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, n_records long"), "warc-files")


def _row(path: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64())], names=["path", "n_records"])


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of ``files`` (a table of paths): page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type and refers_to.  Raises WarcError where an archive is not whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in WarcReader(stream):
                        kind = r.headers["WARC-Type"]
                        held.append((r.page("WARC-Record-ID"), r.url(), r.payload if kind == "response" else None, int(r.http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, r.page("WARC-Refers-To")))
                        size += len(r.payload)
                        if len(held) >= 2000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page written to archives and read back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)
