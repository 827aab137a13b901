"""WARC archives through a chunked record table (operator 1).

``write`` turns pages into rows (record id, chunk number, bytes), deals them by
record id, sorts each partition by chunk number and streams the rows into one
gzip WARC file per task; no task holds more than a chunk of a payload.  A
record's SHA-1 is carried from chunk to chunk and must end at the digest that
was computed beforehand.  ``read_chunks`` gives the archives back as such a
table: every row has the digest of the payload up to and including its chunk.

Of records with equal payloads of at least ``revisit_from`` bytes the one with
the smallest page id (NULL ids last, then by record id) is the response, the
others are revisits that refer to it; smaller payloads are always responses.

A task writes a file of its own name and reports it in a manifest table; files of
lost or repeated attempts are in no manifest and are never read.  The folder must
be one that all executors share and that pyarrow can open (file, hdfs, s3, gs).

Edge cases: a NULL payload is empty; empty payloads are equal to each other;
NULL page ids and urls are written as absent fields and read as NULL; repeated
rows become records of their own, all but the first revisits; an empty table
makes archives without such records.  Only ``page_id``, ``url`` and ``html`` are
read, so extra columns do not matter.
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

from kpiforge.llm.common import bounded_batches, partitions, pick
from kpiforge.session import materialize, scratch_path

CHUNK_BYTES = 64 << 10
_END = b"\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_heads(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """One row per distinct (page_id, url, payload): its size, digest, copies and the record it refers to."""
    heads = _with_id(pages).groupBy("rid", "page_id", "url", "payload_bytes", "sha1").agg(F.count("*").alias("copies"))
    heads = materialize(heads, "warc-heads")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")
    first = heads.groupBy("sha1", "payload_bytes").agg(F.min(rank).alias("first"), F.sum("copies").alias("n"))
    first = first.filter((F.col("n") > 1) & (F.col("payload_bytes") >= revisit_from))
    first = materialize(first.select("sha1", "payload_bytes", "first.rid", "first.page_id").toDF("sha1", "payload_bytes", "first_rid", "first_page"), "warc-first")
    return heads.join(first, ["sha1", "payload_bytes"], "left")


def _with_id(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body")).withColumn("payload_bytes", F.octet_length("body").cast("long"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("page_id", "url")]
    return rows.withColumn("rid", F.md5(F.concat_ws("\x01", *named, "sha1").cast("binary")))


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(rid, chunk_no, data): the payloads in pieces; an empty payload has one empty piece."""
    rows = _with_id(pages)
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes) - 1, F.lit(0)).cast("int")
    rows = rows.select("rid", "body", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.substring(F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return rows.select("rid", "chunk_no", piece.alias("data"))


class _Writer:
    """One gzip member per record, written as the chunks come."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.records, self.written = out, 0, 0

    def begin(self, fields: list[tuple[str, str]], length: int) -> None:
        self.gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(length))])
        self.put(b"WARC/1.1\r\n" + head.encode() + b"\r\n")

    def put(self, data: bytes) -> None:
        self._flush(self.gzip.compress(data))

    def end(self) -> None:
        self._flush(self.gzip.compress(_END) + self.gzip.flush())
        self.records += 1

    def _flush(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)


def _urn(rid: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(rid) if not copy else uuid.uuid5(uuid.UUID(rid), str(copy))}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _fields(head: dict, copy: int, kind: str) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(head["rid"], copy)), ("WARC-Date", _DATE)]
    fields.append(("WARC-Payload-Digest", f"sha1:{_base32(bytes.fromhex(head['sha1']))}"))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    fields.append(("X-Payload-Length", str(head["payload_bytes"])))
    if head["page_id"] is not None:
        fields.append(("X-Page-Id", str(head["page_id"])))
    if head["url"] is not None:
        fields.append(("WARC-Target-URI", quote(head["url"], safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _urn(head["first_rid"], 0)))
        if head["first_page"] is not None:
            fields.append(("X-Refers-To-Page-Id", str(head["first_page"])))
    return fields


def _write_records(rows: Iterator[dict], writer: _Writer) -> None:
    """``rows``: for each record its head (chunk -1), then its chunks in order, perhaps repeated."""
    head, sha, open_, due, held = None, None, False, 0, []
    for row in rows:
        if row["chunk_no"] < 0:
            _finish(head, sha, open_, held, writer)
            head, sha, due, held = row, hashlib.sha1(), 0, []
            grouped = head["first_rid"] is not None
            open_ = not grouped or head["first_rid"] == head["rid"]
            for copy in range(1 if open_ else 0, head["copies"] if grouped else 0):
                writer.begin(_fields(head, copy, "revisit"), len(_http(0)))
                writer.put(_http(0))
                writer.end()
            if open_:
                http = _http(head["payload_bytes"])
                writer.begin(_fields(head, 0, "response"), len(http) + head["payload_bytes"])
                writer.put(http)
        elif open_ and row["chunk_no"] == due:  # a repeated row repeats its chunks
            due += 1
            sha.update(row["data"])
            writer.put(row["data"])
            if head["first_rid"] is None and head["copies"] > 1:
                held.append(row["data"])  # below the revisit size: small by definition
    _finish(head, sha, open_, held, writer)


def _finish(head: dict | None, sha, open_: bool, held: list[bytes], writer: _Writer) -> None:
    if head is None or not open_:
        return
    if sha.hexdigest() != head["sha1"]:
        raise ValueError(f"record {head['rid']}: its chunks do not have the digest of its payload")
    writer.end()
    for copy in range(1, head["copies"] if head["first_rid"] is None else 0):
        body = b"".join(held)
        writer.begin(_fields(head, copy, "response"), len(_http(len(body))) + len(body))
        writer.put(_http(len(body)) + body)
        writer.end()


def write(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Write the archives; the manifest (path, records, bytes) names the files that count."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    heads = record_heads(pages, revisit_from).withColumn("chunk_no", F.lit(-1))
    columns = ["rid", "chunk_no", "page_id", "url", "payload_bytes", "sha1", "copies", "first_rid", "first_page", "data"]
    heads = heads.withColumn("data", F.lit(None).cast("binary")).select(*columns)
    rows = heads.unionByName(chunk_rows(pages), allowMissingColumns=True)
    rows = rows.repartition(partitions(spark), "rid").sortWithinPartitions("rid", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    yield b.slice(i, 1).to_pylist()[0]

        where, base = _open_folder(folder)
        where.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        with where.open_output_stream(f"{base}/{name}", compression=None) as out:
            writer = _Writer(out)
            writer.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE)], 0)
            writer.end()
            _write_records(each(), writer)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [writer.records - 1], "bytes": [writer.written]})

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class _Members:
    """The gzip members of a stream, one after the other, each read piece by piece."""

    def __init__(self, raw: pa.NativeFile):
        self.raw, self.rest = raw, b""

    def next(self) -> bool:
        self.rest = self.rest or self.raw.read(CHUNK_BYTES)
        self.gzip, self.buffer = zlib.decompressobj(31), b""
        return bool(self.rest)

    def _more(self, most: int) -> bytes:
        while not self.gzip.eof:
            data = self.gzip.decompress(self.rest, most)
            self.rest = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            if data:
                return data
            if not self.gzip.eof and not self.rest:
                self.rest = self.raw.read(CHUNK_BYTES)
                if not self.rest:
                    raise ValueError("archive ends inside a record")
        return b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            data = self._more(4096)
            if not data:
                raise ValueError("record without the end of its header")
            self.buffer += data
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        """Exactly n bytes (n is at most a chunk)."""
        while len(self.buffer) < n:
            data = self._more(n - len(self.buffer))
            if not data:
                raise ValueError("record shorter than its length")
            self.buffer += data
        found, self.buffer = self.buffer[:n], self.buffer[n:]
        return found

    def skip(self) -> None:
        while self._more(CHUNK_BYTES):
            pass


def _chunks(raw: pa.NativeFile, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    members = _Members(raw)
    while members.next():
        lines = members.until(_END).decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        kind = head["WARC-Type"]
        if kind not in ("response", "revisit"):
            members.skip()
            continue
        http = members.until(_END)
        left = int(head["Content-Length"]) - len(http) - len(_END)
        declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
        row = {
            "record_id": head["WARC-Record-ID"],
            "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
            "record_type": kind,
            "refers_to": int(head["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in head else None,
            "payload_bytes": int(head["X-Payload-Length"]),
            "payload_digest": declared,
        }
        sha, number, offset = hashlib.sha1(), 0, 0
        while number == 0 or left > 0:
            data = members.take(min(left, chunk_bytes))
            left -= len(data)
            sha.update(data)
            running = _base32(sha.digest()) if kind == "response" else declared
            if kind == "response" and left == 0 and (running != declared or offset + len(data) != row["payload_bytes"]):
                raise ValueError(f"{row['record_id']}: payload and digest differ")
            piece = {"chunk_no": number, "offset": offset, "length": len(data), "running_digest": running, "last": left == 0}
            yield row | piece | {"data": data if with_data else None}
            number, offset = number + 1, offset + len(data)
        members.skip()


_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk_no int, offset long, length int, running_digest string, last boolean, data binary"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("chunk_no", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int32()),
        ("running_digest", pa.string()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
    ]
)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest; the digests are checked on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                where, at = _open_folder(path)
                rows: list[dict] = []
                with where.open_input_stream(at, compression=None) as raw:
                    for row in _chunks(raw, chunk_bytes, with_data):
                        rows.append(row)
                        if len(rows) >= (64 if with_data else 2000):
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = manifest.select("path").repartition(partitions(manifest.sparkSession), "path")
    return files.mapInArrow(run, _SCHEMA)
