"""WARC archives: write one gzip member per record, read back sequentially.

The writer puts each partition's pages into .warc.gz files of a bounded size in the shared folder and returns a
manifest; only files that a finished task reported are in it, so a retried or speculative task leaves nothing that
is read. The reader takes a file as a stream: incremental zlib decompression, one member per record, framing by
Content-Length, and every digest verified. Pages with equal payloads of at least 1000 bytes are stored once, under
the largest page_id; the others are revisit records with the HTTP head alone.

Defined cases: null html is an empty payload; null url is an empty target; of rows repeated with the winning
page_id and payload all are responses; a null page_id never wins and is never a revisit; a payload of exactly 1000
bytes counts as large; a very long payload is one record, compressed and read as a stream of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm.common import buckets_for, fresh_path, materialise, table

CRLF = b"\r\n"
CHUNK = 1 << 16


def _head(first: bytes, fields: list[tuple[bytes, bytes]]) -> bytes:
    return first + CRLF + b"".join(k + b": " + v.translate(None, b"\r\n") + CRLF for k, v in fields) + CRLF


def _b32(sha1: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(sha1)


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One uncompressed record: a response, or a revisit of refers_to."""
    http = _head(b"HTTP/1.1 200 OK", [(b"Content-Type", b"text/html; charset=utf-8"), (b"Content-Length", str(len(payload)).encode())])
    block = http if refers_to is not None else http + payload
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", _urn(page_id)),
        (b"WARC-Date", b"1970-01-01T00:00:00Z"),
        (b"WARC-Target-URI", url.encode()),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", _b32(hashlib.sha1(payload).digest())),
        (b"WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
    ]
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", _urn(refers_to)), (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _head(b"WARC/1.1", [*fields, (b"Content-Length", str(len(block)).encode())]) + block + CRLF + CRLF


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream):
    """The decompressed bytes of each gzip member of a stream, in order."""
    rest = b""
    while True:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            data = rest or stream.read(CHUNK)
            rest = b""
            if not data:
                if out:
                    raise ValueError("the archive ends within a member")
                return
            out.append(d.decompress(data))
        rest = d.unused_data
        yield b"".join(out)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:] if x)}


def parse(data: bytes) -> dict:
    """One record, framed and verified."""
    head, sep, rest = data.partition(CRLF + CRLF)
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    w = _fields(head)
    n = int(w[b"content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != CRLF + CRLF:
        raise ValueError("a record's length differs from its Content-Length")
    if _b32(hashlib.sha1(block).digest()) != w[b"warc-block-digest"]:
        raise ValueError("a block's digest differs")
    http, _, payload = block.partition(CRLF + CRLF)
    kind, said = w[b"warc-type"].decode(), base64.b32decode(w[b"warc-payload-digest"].removeprefix(b"sha1:"))
    length = int(_fields(http)[b"content-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != said):
        raise ValueError("a payload's length or digest differs")
    number = lambda x: int(d) if (d := x.removeprefix(b"<urn:page:").removesuffix(b">")) else None
    return {"page_id": number(w[b"warc-record-id"]), "url": w[b"warc-target-uri"].decode(), "record_type": kind, "payload_bytes": length, "payload_digest": said.hex(), "refers_to": number(w[b"warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


MANIFEST = "path string, records long, bytes long"


def _writer(out_dir: str, max_bytes: int):
    def rows(batches):
        store, base = fs.FileSystem.from_uri(out_dir)
        store.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        stem = f"{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex}"
        out, path, made, paths = None, "", 0, []

        def end():
            out.close()
            paths.append([path, records, made])

        for b in batches:
            for i, u, h, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path, made, records = f"{base}/{stem}-{len(paths):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = member(record(i, u or "", (h or "").encode(), r))
                out.write(data)
                made, records = made + len(data), records + 1
                if made >= max_bytes:
                    end()
                    out = None
        if out is not None:
            end()
        if paths:
            p, n, m = zip(*paths, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["path", "records", "bytes"])

    return rows


def write_warc(pages: DataFrame, out_dir: str, min_bytes: int = 1000, max_bytes: int = 64 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as archives below out_dir; returns the written manifest (path, records, bytes)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    big = p.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    winners = big.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to <> least").drop("least")
    winners = materialise(winners, "winners")  # both sides of the join are then plain exchanges, whose hot keys can be split
    again = big.join(winners, "sha1").where("page_id <> refers_to").distinct()
    rows = p.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")
    return materialise(rows.mapInArrow(_writer(out_dir, max_bytes), MANIFEST), "manifest")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
READ_ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def _reader(out_dir: str, payloads: bool, batch: int = 256):
    def pack(recs):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in recs], t) for k, t in READ_ARROW], names=[k for k, _ in READ_ARROW])

    def rows(batches):
        store, _ = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for path, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got, recs = 0, []
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        r = parse(data)
                        if not payloads:
                            r["payload"] = None
                        recs.append(r)
                        got += 1
                        if len(recs) == batch:
                            yield pack(recs)
                            recs = []
                if got != want:
                    raise ValueError(f"{path} holds {got} records, not {want}")
                if recs:
                    yield pack(recs)

    return rows


def read_warc(manifest: DataFrame, out_dir: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives of a manifest, one task a file or more."""
    n = buckets_for(manifest.count(), 1)
    return manifest.select("path", "records").repartition(n).mapInArrow(_reader(out_dir, payloads), READ)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(manifest, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM w
"""
