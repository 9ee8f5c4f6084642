"""WARC archives: one gzip member per record, written and read by Spark tasks.

Reading is sequential and incremental: a task pulls an archive in blocks, inflates one gzip member
at a time, frames the record by its Content-Length and checks its digests, so memory holds one
record, whatever the archive's size. Archives lie in the folder that all executors share, under
names that depend on the partition only; a retried task writes the same file again and renames it
into place.

Defined results: a null payload is an empty one; a null url has an empty target URI; a null page_id
has a record without a page number and is never the first of its payload while another id exists;
repeated rows with the smallest page_id are all responses; an empty table gives no archive and no
row; other columns of the input are not read. A record that can't be parsed gives one row of type
"error" with the reason and ends its archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, partitions, shared_dir, table

_BLOCK = 1 << 20
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, digest_ok boolean, payload_bytes long, payload binary, error string"
)


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One gzip member. With first the record is a revisit of that page: it keeps the HTTP head,
    whose Content-Length tells the payload's size, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if first is None else b"")
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        fields += [("WARC-Refers-To", _record_id(first)), ("WARC-Profile", _REVISIT_PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, revisit_min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = 1 << 28) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives of about
    archive_bytes in folder; returns (path, records) of each archive. Equal payloads meet through
    the smallest page_id of each digest, aggregated before the shuffle; the join back is an
    equi-join whose hot digests Spark splits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = rows.where(F.octet_length("html") >= revisit_min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "sha", "left").select(
        "page_id", "url", "html", "sha", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, number, out, done, size, count = TaskContext.get().partitionId(), 0, None, [], 0, 0
        passing = ""

        def close() -> None:
            nonlocal out, number, size, count
            out.close()
            files.move(passing, path := f"{root}/part-{part:06d}-{number:04d}.warc.gz")
            done.append((path, count))
            out, number, size, count = None, number + 1, 0, 0

        for batch in batches:
            cells = [batch.column(k) for k in range(5)]
            for i in range(batch.num_rows):
                page_id, url, html, sha, of = (c[i].as_py() for c in cells)
                if out is None:
                    passing = f"{root}/.{part:06d}-{number:04d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(passing, compression=None)
                data = encode_record(page_id, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(sha).decode(), of, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        scheme = folder.split(":", 1)[0] + ":" if re.match(r"[a-z0-9]+:", folder) else ""
        yield pa.RecordBatch.from_arrays([pa.array([f"{scheme}//{p}" if scheme else p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return rows.mapInArrow(write, "path string, records long")


class _Member:
    """The inflated bytes of gzip members, one member after the other, of a stream."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.offset, self.inflate = stream, b"", 0, None

    def next(self) -> bool:
        """Goes to the next member; False at the end of the archive."""
        while not self.raw or not self.raw.lstrip(b"\0"):
            self.offset += len(self.raw)
            self.raw = self.stream.read(_BLOCK)
            if not self.raw:
                return False
        self.inflate = zlib.decompressobj(31)
        return True

    def read(self) -> bytes:
        """Some more bytes of this member; empty at its end."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(_BLOCK)
                if not self.raw:
                    raise ValueError("the archive ends inside a gzip member")
            before = len(self.raw)
            data = self.inflate.decompress(self.raw, _BLOCK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.offset += before - len(self.raw)
            if data:
                return data
        return b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC version line")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream) -> Iterator[tuple]:
    """(offset, type, id, uri, refers_to, payload digest, digests hold, payload size, payload, error)."""
    member = _Member(stream)
    while True:
        start = member.offset
        try:
            if not member.next():
                return
            start = member.offset
            buffer = bytearray()
            while (cut := buffer.find(b"\r\n\r\n")) < 0:
                data = member.read()
                if not data:
                    raise ValueError("the record has no header end")
                buffer += data
            fields = _fields(bytes(buffer[:cut]))
            length = int(fields["content-length"])
            del buffer[: cut + 4]
            while data := member.read():
                buffer += data
            if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
                raise ValueError("the record's length isn't its Content-Length")
            block = bytes(buffer[:length])
            head, mark, payload = block.partition(b"\r\n\r\n")
            kind = fields.get("warc-type", "")
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            ok = bool(mark) and fields.get("warc-block-digest", "").removeprefix("sha1:") == _base32_sha1(block)
            if kind != "revisit":
                ok = ok and digest == _base32_sha1(payload)
            n = int(size[1]) if kind == "revisit" and size else len(payload)
            yield start, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, ok, n, payload if kind != "revisit" else None, None
        except (ValueError, KeyError, zlib.error) as e:
            yield start, "error", None, None, None, None, False, None, None, f"{type(e).__name__}: {e}"
            return


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives whose column path names them, once each, as RECORD_SCHEMA."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for r in records(stream):
                        rows.append((path, *r))
                        size += 200 + len(r[8] or b"")
                        if size > 4 * _BLOCK:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # Paths are short rows for much work: dealt by a number of partitions, which adaptive execution keeps.
    return archives.select("path").repartition(partitions(archives.sparkSession), "path").mapInArrow(read, RECORD_SCHEMA)


def page_number(column: str):
    return F.nullif(F.regexp_extract(column, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def whole(records: DataFrame) -> DataFrame:
    """The records; a job that meets one that couldn't be read fails and names its place."""
    where = F.concat(F.lit("unreadable record in "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "error")
    return records.withColumn("record_type", F.when(F.col("record_type") == "error", F.raise_error(where).cast("string")).otherwise(F.col("record_type")))


def round_trip(spark, sf_dir: str) -> DataFrame:
    """Query op8_warc: archives of all pages, written to the shared folder and read back; digest_ok tells whether the
    digests of a record hold."""
    folder = f"{shared_dir(spark)}/quillspark/warc-{uuid.uuid4().hex}"
    written = materialize(write_archives(table(spark, sf_dir, "pages"), folder), "warc-index")
    return whole(read_archives(written)).select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
        "digest_ok",
    )
