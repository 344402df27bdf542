"""WARC archives: one gzip member per record, written by executors and read sequentially.

Writer: the records of a partition go to archives in a shared folder, each a run of
gzip members. Of records with equal payloads of at least ``REVISIT_BYTES`` the one with
the largest id is a response; the others revisit it, without payload.

Reader: an archive is read in small chunks through an incremental zlib decompressor, a
member at a time; content-length frames a record's block, and block and payload digests
are verified. Memory is one record.

A task writes under a name of its own and reports the archive in the manifest when it
is complete, so a lost or repeated task leaves at most a file that nobody reads. The
folder is ``spark.checkpoint.dir`` (or one given), reached through pyarrow's file
systems. Null payloads are empty; ids of any type are written as text, percent-encoded, a null id as ``null``; a null url is
``urn:page:<id>``. Repeated rows are records of their own. An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import qualified, shared_path, stored

REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes that a reading task is given (about), where there are more archives than cores.
READ_BYTES = 64 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that cannot be framed or whose digest does not fit."""


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(ident: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<urn:page:{ident}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to else []),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, fed = zlib.decompressobj(31), [], False
    raw = stream.read(CHUNK)
    while raw:
        parts.append(z.decompress(raw))
        fed = True
        if z.eof:
            yield b"".join(parts)
            raw, z, parts, fed = z.unused_data or stream.read(CHUNK), zlib.decompressobj(31), [], False
        else:
            raw = stream.read(CHUNK)
    if fed:
        raise WarcError("the archive ends within a gzip member")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of every record, framed and verified."""
    for raw in members(stream):
        head, mark, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not mark or not first.startswith("WARC/1."):
            raise WarcError("a member does not begin with a record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(fields["content-length"])
        block, after = rest[:length], rest[length:]
        if len(block) != length or after != b"\r\n\r\n":
            raise WarcError("content-length does not frame the record")
        if fields["warc-block-digest"] != _sha1(block):
            raise WarcError("the block digest does not fit")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != _sha1(payload):
            raise WarcError("the payload digest does not fit")
        yield fields, http, payload


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which page is a response and which revisits one.

    The winners' table holds only digests that occur twice or more; its join is a plain
    equi-join, which Spark splits where one payload has very many copies.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id")
    first = large.groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    refers = F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(plan: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records as archives below ``folder``; the manifest (path, records, bytes), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for ident, url, payload, digest, refers in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                ident = "null" if ident is None else quote(str(ident), safe="")
                base32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                raw = record(ident, f"urn:page:{ident}" if url is None else url, payload, base32, None if refers is None else quote(str(refers), safe=""), date)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        for path, number, length in done:
            yield pa.record_batch([pa.array([path]), pa.array([number], pa.int64()), pa.array([length], pa.int64())], names=["path", "records", "bytes"])

    plan = plan.select("page_id", "url", "payload", "digest", "refers_to")
    return stored(plan.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's archives: (page_id, url, payload_bytes, payload_digest, record_type, refers_to).

    Ids are text, as a record holds them. Archives are dealt evenly over tasks whose number follows the manifest.
    """
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        ident = lambda x: None if x == "<urn:page:null>" else unquote(x[10:-1])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, http, payload in records(stream):
                        said = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                        response = fields["warc-type"] == "response"
                        if response and said != len(payload):
                            raise WarcError("the payload's length does not fit")
                        refers = fields.get("warc-refers-to")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((ident(fields["warc-record-id"]), fields["warc-target-uri"], said, digest, fields["warc-type"], ident(refers) if refers else None))
                        if len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    archives, total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(archives, max(-(-(total or 0) // READ_BYTES), spark.sparkContext.defaultParallelism)))
    return manifest.select("path").repartition(tasks).mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page's record, then read the archives back."""
    folder = qualified(pages.sparkSession, shared_path(pages.sparkSession, "warc"))
    out = read(write(planned(pages, page_id, url, html), folder), folder)
    kind = pages.schema[page_id].dataType
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
