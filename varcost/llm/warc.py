"""WARC archives: written by tasks, one gzip member per record, and read back sequentially.

The writer decides between response and revisit records with a join, and its tasks stream the records
into archive files in a folder that all executors share. The reader walks each archive from
front to back: it decompresses member by member with an incremental zlib object, frames
header and block by Content-Length, and verifies both digests. Neither holds more than a chunk of
compressed data and one record's headers besides the payload at hand.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import FILE, ROW, text_of, with_locator
from varcost.sinks.scratch import scratch_folder, stage

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"
# The name of a page without an id; an empty id is another one.
_NO_PAGE = "<urn:x-no-page:>"
_SAFE = ":/?#[]@!$&'()*+,;=%-._~"

RECORDS = "page_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, target_uri string"


def _urn(page_id: str | None) -> str:
    return _NO_PAGE if page_id is None else f"<{_URN}{quote(page_id, safe='')}>"


def sha1_base32(*parts: bytes) -> str:
    digest = hashlib.sha1()
    for part in parts:
        digest.update(part)
    return base64.b32encode(digest.digest()).decode()


# Writing -----------------------------------------------------------------------------------


def encode_record(
    page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str, level: int
) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with its length, but no payload."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    body = b"" if revisit else payload
    name = _urn(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=_SAFE) if url else name[1:-1]),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(http, body)}"),
    ]
    if revisit:
        fields.append(("WARC-Profile", REVISIT_PROFILE))
        fields.append(("WARC-Refers-To", _urn(refers_to)))
    fields.append(("Content-Length", str(len(http) + len(body))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head), packer.compress(http), packer.compress(body), packer.compress(b"\r\n\r\n"), packer.flush()))


def _writer(folder: str, date: str, level: int, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        made, out, size, records = [], None, 0, 0

        def close():
            nonlocal out
            out.close()
            made.append((f"{folder}/{name}", records))
            out = None

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # Attempts never share a file; the reader sees those of the attempt that counted.
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, size, records = where.open_output_stream(f"{base}/{name}"), 0, 0
                member = encode_record(page_id, url, html.encode(), refers_to, revisit, date, level)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([p for p, _ in made], pa.string()), "n_records": pa.array([n for _, n in made], pa.int64()),
        })

    return write


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2020-01-01T00:00:00Z",
    level: int = 6,
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record per row and return the archives: ``path, n_records``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest id is a
    response (a NULL id is the largest; of repeated ids the first one stored) and the others revisit it; smaller
    payloads are all responses. A NULL payload is empty, a NULL url is replaced by the record's
    name. Payloads are equal when their SHA-256 and length are. An empty table gives no archives. Other columns are
    not read. Rows are joined to their group's first by digest; adaptive execution splits hot groups.
    """
    spark = pages.sparkSession
    folder = folder or f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    rows = with_locator(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")), "pages"
    ).withColumn("html", text_of("html"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", FILE, ROW)
    first = (
        keyed.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("key").agg(F.min(order).alias("first"))
    )
    same = (F.col("first")[FILE] == F.col(FILE)) & (F.col("first")[ROW] == F.col(ROW))
    records = keyed.join(first, "key", "left").select(
        F.col("page_id").cast("string"), F.col("url").cast("string"), "html", F.col("first.page_id").cast("string").alias("refers_to"),
        (F.col("first").isNotNull() & ~same).alias("revisit"),
    )
    made = records.mapInArrow(_writer(folder, date, level, archive_bytes), "path string, n_records bigint")
    return stage(made, "archives")


# Reading -----------------------------------------------------------------------------------


class Member:
    """One gzip member of a stream, decompressed as it is read."""

    def __init__(self, source: "Archive"):
        self._source, self._unpacker, self._buffer = source, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        if self._unpacker.eof:
            return False
        raw = self._source.take()
        if not raw:
            raise ValueError("the archive ends inside a member")
        self._buffer += self._unpacker.decompress(raw, self._source.chunk)
        self._source.give_back(self._unpacker.unused_data or self._unpacker.unconsumed_tail)
        return True

    def line(self) -> bytes:
        """The next line, of any length: the writer puts a whole url into one."""
        parts = []
        while b"\r\n" not in self._buffer:
            # The last byte stays, it may be half of the line's end.
            parts.append(self._buffer[:-1])
            self._buffer = self._buffer[-1:]
            if not self._more():
                raise ValueError("a header line does not end")
        line, self._buffer = self._buffer.split(b"\r\n", 1)
        return b"".join((*parts, line))

    def read(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, in pieces."""
        while size:
            if not self._buffer and not self._more():
                raise ValueError("the record is shorter than its Content-Length")
            piece, self._buffer = self._buffer[:size], self._buffer[size:]
            size -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        if b"".join(self.read(4)) != b"\r\n\r\n" or self._buffer:
            raise ValueError("the record does not end where its Content-Length says")
        while self._more():
            if self._buffer:
                raise ValueError("data after the record")


class Archive:
    """The compressed bytes of an archive, front to back."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self._stream, self._rest, self.chunk = stream, b"", chunk

    def take(self) -> bytes:
        raw, self._rest = self._rest or self._stream.read(self.chunk), b""
        return raw

    def give_back(self, raw: bytes) -> None:
        self._rest = raw

    def ended(self) -> bool:
        self._rest = self.take()
        return not self._rest


def _headers(member: Member, first: bytes) -> tuple[dict[str, str], int]:
    line = member.line()
    if not line.startswith(first):
        raise ValueError(f"expected {first!r}, found {line[:40]!r}")
    size, fields = len(line) + 2, {}
    while line := member.line():
        size += len(line) + 2
        key, _, value = line.decode().partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields, size + 2


def _page(urn: str | None) -> str | None:
    from urllib.parse import unquote

    return None if urn in (None, _NO_PAGE) else unquote(urn.strip("<>").removeprefix(_URN))


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """Every record of an archive in order; raises ValueError where framing or a digest is wrong."""
    archive = Archive(stream)
    while not archive.ended():
        member = Member(archive)
        fields, _ = _headers(member, b"WARC/")
        length = int(fields["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        # The block starts with an HTTP head, which is hashed as it was written.
        head, size = [], 0
        while True:
            line = member.line()
            head.append(line + b"\r\n")
            size += len(line) + 2
            if not line:
                break
        http = dict(h.decode().strip().lower().partition(":")[::2] for h in head[1:-1])
        for line in head:
            block.update(line)
        for piece in member.read(length - size):
            block.update(piece)
            payload.update(piece)
            if with_payload:
                kept.append(piece)
        member.finish()
        declared = fields["warc-payload-digest"].removeprefix("sha1:")
        if base64.b32encode(block.digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"wrong block digest in {fields['warc-record-id']}")
        revisit = fields["warc-type"] == "revisit"
        n_bytes = int(http["content-length"])
        if not revisit and (base64.b32encode(payload.digest()).decode() != declared or n_bytes != length - size):
            raise ValueError(f"wrong payload digest in {fields['warc-record-id']}")
        yield {
            "page_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"],
            "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": n_bytes, "payload_digest": declared,
            "target_uri": fields["warc-target-uri"], **({"payload": b"".join(kept)} if with_payload else {}),
        }


def _reader(with_payload: bool, schema: pa.Schema, batch_bytes: int = 4 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_records in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = fs.FileSystem.from_uri(path)
                rows, size, seen = [], 0, 0
                with where.open_input_stream(name) as stream:
                    for record in read_records(stream, with_payload):
                        rows.append(record)
                        seen += 1
                        size += 200 + len(record.get("payload", b""))
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                if n_records is not None and seen != n_records:
                    raise ValueError(f"{path} has {seen} of {n_records} records")

    return read


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives (``path, n_records``), one row each, in a task per archive.

    Columns: ``page_id, record_type, refers_to, payload_bytes, payload_digest, target_uri``, and ``payload`` if
    asked for (empty for a revisit). Length and digest are those of the full payload, for
    a revisit too. A broken archive, or one that lacks records, fails the job. No archives give no rows.
    """
    fields = [("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target_uri", pa.string())]
    if with_payload:
        fields.append(("payload", pa.binary()))
    schema = RECORDS + (", payload binary" if with_payload else "")
    spread = archives.select("path", "n_records").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(_reader(with_payload, pa.schema(fields)), schema)
