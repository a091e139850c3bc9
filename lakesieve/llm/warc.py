"""WARC archives through a table of payload chunks.

Writing: each payload becomes rows (record id, chunk number) of CHUNK_BYTES at most; every chunk is a WARC record by
itself (the standard's segmented records: a response or revisit, then `continuation` records). Python slices the payload
where Arrow holds it and allocates a chunk at a time; the table's row itself is whole, as Spark reads it, and its digest is taken twice, for
revisits and for the header. Spark's own writer puts the archives wherever it can write. Reading streams the archive files back
through a small state machine that carries the running SHA-1 of the record at hand from chunk to chunk and compares it
with the digest in the header.

A payload that an earlier-read record of larger id holds too is written as a revisit, without its bytes. Payloads are
UTF-8 texts or bytes of any length; null means empty. A row without id gets a random-free id from its digest and is always a response;
rows that repeat id and payload are written each; columns other than id, url and payload aren't read; an empty table
gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.llm._spark import cut, fresh_path, shared_folder

CHUNK_BYTES = 64 << 10
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
#: Bytes of the list of revisits up to which every task gets it; beyond, pages and list are joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def urn(record) -> str:
    return f"urn:page:{record}"


def target_uri(url: str | None, record: str) -> str:
    """The URL with blanks, control and non-ASCII characters percent-encoded."""
    if not url:
        return urn(record)
    return re.sub(rb"[^\x21-\x7E]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def header(kind: str, record: str, number: int, length: int, fields: dict[str, str]) -> bytes:
    own = urn(record) if number == 1 else f"{urn(record)}:{number}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def segments(record: str, url: str | None, payload: bytes | pa.Buffer, refers_to: str | None, chunk: int):
    """The WARC records (without the two line ends that close each) of one payload, which is read a chunk at a time."""
    view, sha = memoryview(payload), hashlib.sha1()
    for i in range(0, len(view), chunk):
        sha.update(view[i : i + chunk])
    common = {"WARC-Target-URI": target_uri(url, record), "WARC-Payload-Digest": f"sha1:{base32(sha.digest())}", "X-Payload-Length": str(len(view))}
    if refers_to is not None:
        common |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{urn(refers_to)}>"}
        yield header("revisit", record, 1, 0, common)
        return
    head = HEAD % len(view)
    parts = max(1, -(-len(view) // chunk))
    for k in range(parts):
        part = view[k * chunk : (k + 1) * chunk]
        fields = {"WARC-Segment-Number": str(k + 1)} if parts > 1 else {}
        if k == 0:
            fields |= common | {"Content-Type": "application/http;msgtype=response"}
        else:
            fields["WARC-Segment-Origin-ID"] = f"<{urn(record)}>"
        if parts > 1 and k == parts - 1:
            fields["WARC-Segment-Total-Length"] = str(len(head) + len(view))
        start = head if k == 0 else b""
        yield b"".join((header("response" if k == 0 else "continuation", record, k + 1, len(start) + len(part), fields), start, part))


def revisits(pages: DataFrame, record: str, payload: str, least: int = 0) -> DataFrame:
    """(id, sha, refers_to) of the records whose payload a record of larger id holds too."""
    sha = pages.select(F.col(f"`{record}`").alias("id"), _sha(payload).alias("sha"), F.length(_raw(payload)).alias("n")).where(f"id is not null and n >= {int(least)}").select("id", "sha")
    kept = sha.groupBy("sha").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    return sha.join(kept, "sha").where("id < refers_to").distinct()


def _raw(payload: str):
    return F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))


def _sha(payload: str):
    return F.unhex(F.sha2(_raw(payload), 256))


def write_archives(pages: DataFrame, path: str, record: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK_BYTES) -> None:
    """Gzipped archives of `pages` under `path`."""
    again = cut(revisits(pages, record, payload, least), "warc-revisits")
    if again.count() * 64 <= MAX_BROADCAST_BYTES:
        again = F.broadcast(again)
    rows = pages.select(F.col(f"`{record}`").alias("id"), F.col(f"`{url}`").alias("url"), _raw(payload).alias("raw"), _sha(payload).alias("sha"))
    rows = rows.join(again, ["id", "sha"], "left").select(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("sha256-"), F.hex("sha"))).alias("id"), "url", "raw", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches):
        out, size = [], 0
        for batch in batches:
            ids, urls, raws, refers = batch.columns
            for i in range(batch.num_rows):
                for piece in segments(ids[i].as_py(), urls[i].as_py(), raws[i].as_buffer(), refers[i].as_py(), chunk):
                    out.append(piece)
                    size += len(piece)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path))


class Reader:
    """Feed it the bytes of archives; it gives a tuple for each chunk and holds no more than one chunk."""

    def __init__(self, payloads: bool):
        self.payloads, self.head, self.want, self.fields, self.body = payloads, b"", 0, None, []
        self.origin, self.sha, self.n, self.digest, self.total, self.first = None, None, 0, None, 0, {}

    def feed(self, piece: bytes):
        while piece:
            if self.fields is None:
                self.head += piece
                if (at := self.head.find(END)) < 0:
                    return
                piece, lines = self.head[at + 4 :], self.head[:at].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                self.fields = dict(x.split(": ", 1) for x in lines[1:])
                self.head, self.body, self.want = b"", [], int(self.fields["Content-Length"]) + len(END)
            taken, piece = piece[: self.want], piece[self.want :]
            self.body.append(taken)
            self.want -= len(taken)
            if not self.want:
                body, fields = b"".join(self.body), self.fields
                self.fields, self.body = None, []
                if body[-4:] != END:
                    raise ValueError(f"{fields['WARC-Record-ID']} has a wrong length")
                yield self.chunk(fields, body[:-4])

    def chunk(self, fields: dict[str, str], body: bytes):
        number = int(fields.get("WARC-Segment-Number", 1))
        if fields["WARC-Type"] != "continuation":
            if self.origin is not None:
                raise ValueError(f"{self.origin} is not complete")
            self.first, self.origin, self.sha, self.n = fields, fields["WARC-Record-ID"], hashlib.sha1(), 0
            body = body[body.index(END) + 4 :] if fields["WARC-Type"] == "response" else body
        elif fields["WARC-Segment-Origin-ID"] != self.origin:
            raise ValueError(f"{fields['WARC-Record-ID']} does not follow its origin")
        self.sha.update(body)
        self.n += len(body)
        kind, refers = self.first["WARC-Type"], self.first.get("WARC-Refers-To")
        last = kind == "revisit" or self.n == int(self.first["X-Payload-Length"])
        digest = self.first["WARC-Payload-Digest"].removeprefix("sha1:")
        if last and kind == "response" and base32(self.sha.digest()) != digest:
            raise ValueError(f"{self.origin}: the payload does not have the digest of its header")
        total = int(self.first["X-Payload-Length"])
        own = self.origin[1:-1].removeprefix("urn:page:")
        if last:
            self.origin = None
        return own, number, kind, refers and refers[1:-1].removeprefix("urn:page:"), self.first["WARC-Target-URI"], last, total, digest, body if self.payloads else None


CHUNKS = "record_id string, chunk int, record_type string, refers_to string, target_uri string, is_last boolean, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives under `path`. The last chunk of a record comes after its digest was compared."""
    lines = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary"))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        reader = Reader(payloads)
        for batch in batches:
            rows, size = [], 0
            for piece in batch.column(0):
                for row in reader.feed(piece.as_py() + END):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return lines.mapInArrow(run, CHUNKS)


def archive_folder(spark: SparkSession) -> str:
    shared_folder(spark)
    return fresh_path(spark, "warc")
