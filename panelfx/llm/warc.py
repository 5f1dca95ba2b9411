"""WARC archives: a writer, and a sequential reader.

Each record is one gzip member.  The reader inflates a member piece by piece
with ``zlib.decompressobj``, frames header and block by Content-Length, and
compares the SHA-256 digests of block and payload while it reads, so that
memory stays at one piece and one header whatever an archive's size.

Of rows with equal payloads of at least 100 bytes the one with the smallest id
is stored as ``response``; the others become ``revisit`` records that keep the
response's HTTP header (with the full length) and payload digest.

Archives lie below the shared folder of the session; a writer task writes
under a name of its own and renames the whole archive into place, so a task
that runs again after a lost executor replaces the archive by an equal one.

Defined results: a null payload is empty; rows with a null id are written and
read back with a null id; equal ids are written once per row; an empty table
gives no archive and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.session import scratch_path, stored

MIN_REVISIT = 100
PIECE = 1 << 18
DATE = "2000-01-01T00:00:00Z"  # fixed, so that archives are reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


class WarcError(ValueError):
    """A record that breaks the framing or fails its digest."""


def record_id(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, length: int | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit when ``length`` is given."""
    revisit = length is not None
    block = HTTP.format(length if revisit else len(payload)).encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>",
             f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


@dataclass
class Header:
    fields: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        head, *lines = raw.decode("utf-8", "replace").split("\r\n")
        if not head.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {head[:40]!r}")
        pairs = (line.partition(":") for line in lines if line)
        return cls({k.strip().lower(): v.strip() for k, _, v in pairs})

    def __getitem__(self, name: str) -> str | None:
        return self.fields.get(name.lower())


class Members:
    """Bytes of one gzip member at a time, inflated as they are read."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.raw, self.inflate = stream, b"", None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.inflate = zlib.decompressobj(31) if self.raw else None
        return self.inflate is not None

    def read(self) -> bytes:
        """Some bytes of the member, at most PIECE; b"" at its end."""
        while not self.inflate.eof:
            raw = self.raw or self.inflate.unconsumed_tail or self.stream.read(PIECE)
            if not raw:
                raise WarcError("the archive ends inside a member")
            out = self.inflate.decompress(raw, PIECE)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """Records in order: ``header``, ``http_length``, ``payload_bytes``, ``payload_digest`` of what is stored."""
    members = Members(stream)
    while members.next_member():
        seen = b""
        while b"\r\n\r\n" not in seen:
            piece = members.read()
            if not piece:
                raise WarcError("a record without the end of its header")
            seen += piece
        raw, _, rest = seen.partition(b"\r\n\r\n")
        header = Header.parse(raw)
        if not (header["content-length"] or "").isdigit():
            raise WarcError("a record without Content-Length")
        left = int(header["content-length"])
        block, payload = hashlib.sha256(), hashlib.sha256()
        http, http_length, payload_bytes, tail = b"", None, 0, b""
        piece = rest
        while True:
            part, piece = piece[:left], piece[left:]
            left -= len(part)
            block.update(part)
            if http is not None:
                http += part
                top, gap, part = http.partition(b"\r\n\r\n")
                if gap:
                    for line in top.split(b"\r\n"):
                        name, _, value = line.partition(b":")
                        if name.strip().lower() == b"content-length":
                            http_length = int(value)
                    http = None
                else:
                    part = b""
            payload.update(part)
            payload_bytes += len(part)
            tail += piece
            if not (piece := members.read()):
                break
        if left:
            raise WarcError("a member ends before Content-Length")
        if tail != b"\r\n\r\n":
            raise WarcError("a member goes on after its record")
        if header["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise WarcError("wrong block digest")
        if header["warc-type"] == "response" and header["warc-payload-digest"] != f"sha256:{payload.hexdigest()}":
            raise WarcError("wrong payload digest")
        yield {"header": header, "http_length": http_length, "payload_bytes": payload_bytes, "payload_digest": payload.hexdigest()}


def filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def planned(pages: DataFrame) -> DataFrame:
    """Rows with their digest and, where others have the same payload, the id of the response.

    Only digests that occur twice are joined back, so the join's other side is
    the repeats alone; AQE broadcasts it or splits a hot digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    firsts = (rows.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
              .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    return rows.join(firsts.select("digest", "first"), "digest", "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task; returns path and number of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        final = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, n = f"{root}/.{uuid.uuid4().hex}", 0
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))):
                page_id, url, payload, digest, first = row
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(own, compression=None)
                revisit = first is not None and page_id is not None and page_id != first
                out.write(record(page_id, url, payload, digest, first, len(payload)) if revisit else record(page_id, url, payload, digest))
                n += 1
        if out is not None:
            out.close()
            system.move(own, final)
            yield pa.RecordBatch.from_pydict({"name": [final.rsplit("/", 1)[-1]], "records": pa.array([n], pa.int64())})

    return planned(pages).mapInArrow(run, "name string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the named archives; digests are checked on the way."""
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "archive": pa.string()}

    def number(urn: str | None) -> int | None:
        last = (urn or "").strip("<>").rpartition(":")[2]
        return int(last) if last not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for r in read_records(stream):
                        h = r["header"]
                        revisit = h["warc-type"] == "revisit"
                        rows.append((number(h["warc-record-id"]), r["http_length"] if revisit else r["payload_bytes"],
                                     h["warc-payload-digest"].removeprefix("sha256:") if revisit else r["payload_digest"],
                                     h["warc-type"], number(h["warc-refers-to"]) if revisit else None, name))
                        if len(rows) == 5000:
                            yield table(rows)
                            rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))

    return archives.select("name").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, then read them back; one row per record."""
    folder = folder or scratch_path(spark, "warc")
    archives = stored(write_archives(pages, folder), "warc-index")
    # An archive is read by one task: deal the names out, one or a few to a task.
    return read_archives(archives.repartition(max(1, archives.count()), "name"), folder)
