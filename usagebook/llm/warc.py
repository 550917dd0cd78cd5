"""WARC files of gzip members, and a splittable reader.

Writing: each page is one record in a gzip member of its own. Of pages with equal
payloads of at least MIN_REVISIT bytes the one with the largest page_id is a
response and the others revisit it, without the payload. Each task writes one
file under a temporary name and moves it to the final one when complete.

Reading: a file is cut into byte ranges of SPLIT bytes, however its records lie.
A task looks for the gzip magic in its range; a candidate counts only if it
decompresses to a WARC version line and a complete header block with a length.
A record belongs to the range in which its member starts, and is read to its end
even beyond the range. From one record the next begins where its member ends.
A response's payload is checked against its digest.

Defined cases: a null html is an empty payload; rows that repeat a page_id are
each a record, all of them responses if theirs is the largest page_id; a null
page_id is smaller than any other; a null url is empty; line ends in a url are
percent-encoded; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import full_uri, new_path, stored, table
from usagebook.shipping import ship

MIN_REVISIT = 1000
SPLIT = 8 << 20
#: Bytes read at a time.
READ = 1 << 20
LEVEL = 4
#: Repeated payloads (of about 60 bytes a row) up to which no page is shuffled to find what it revisits; beyond, Spark joins by digest.
BROADCAST_HEADS = 500_000
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A record's bytes; digest is the payload's SHA-1 in hex. With refers_to it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_REVISIT}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    body = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    large = F.octet_length("payload") >= MIN_REVISIT
    heads = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = stored(heads.select(F.col("digest").alias("_digest"), "head"), "warc-heads")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")
    if heads.count() <= BROADCAST_HEADS:
        joined = rows.join(F.broadcast(heads), F.when(large, F.col("digest")) == F.col("_digest"), "left")
        return joined.select(*rows.columns, refers_to)
    # both sides are plain shuffles, so that adaptive execution divides the rows of a large group; small pages don't take part
    joined = rows.where(large).join(heads, F.col("digest") == F.col("_digest"), "left").select(*rows.columns, refers_to)
    return joined.union(rows.where(~large).select("*", F.lit(None).cast("long")))


def write_warc(pages: DataFrame, path: str, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the files and returns (file, size)."""
    ship(pages.sparkSession)
    folder = full_uri(pages.sparkSession, path.rstrip("/"))
    system, local = _open(folder)
    system.create_dir(local, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        system, final = _open(file)
        temporary, sink, size = f"{final}.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            sink = sink or system.open_output_stream(temporary, compression=None)
            columns = [c.to_pylist() for c in batch.columns]
            for ident, address, payload, digest, refers_to in zip(*columns, strict=True):
                packed = member(record(ident, address, payload, digest, refers_to, date))
                sink.write(packed)
                size += len(packed)
        if sink:
            sink.close()
            system.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"file": [file], "size": pa.array([size], pa.int64())})

    return stored(with_revisits(pages, page_id, url, html).mapInArrow(write, "file string, size long"), "warc-files")


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Range:
    """A file from a position on, read as needed."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, bytearray()
        source.seek(start)

    def upto(self, end: int) -> bool:
        """Reads on to position end; False if the file ends before it."""
        while self.start + len(self.data) < end:
            more = self.source.read(READ)
            if not more:
                return False
            self.data += more
        return True

    def forget(self, position: int) -> None:
        del self.data[: position - self.start]
        self.start = position


def read_member(source: Range, position: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record in the member at a position; None if there is none."""
    unpack, out, at, headers = zlib.decompressobj(31), bytearray(), position, None
    while not unpack.eof:
        if not source.upto(at + 1):
            return None
        part = bytes(source.data[at - source.start : at - source.start + (1 << 16)])
        try:
            out += unpack.decompress(part)
        except zlib.error:
            return None
        at += len(part) - len(unpack.unused_data)
        if headers is None:
            if not b"WARC/1.".startswith(out[:7]):
                return None
            if (end := out.find(b"\r\n\r\n")) >= 0:
                headers, body = _headers(bytes(out[:end])), end + 4
                if not headers.get("content-length", "").isdigit():
                    return None
    if headers is None:
        return None
    return headers, bytes(out[body : body + int(headers["content-length"])]), at


def records(source: Range, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, end)."""
    at = start
    while at < end:
        source.forget(at)
        source.upto(min(end, at + READ) + len(MAGIC) - 1)
        found = source.data.find(MAGIC)
        if found < 0:
            at = max(at + 1, min(end, source.start + len(source.data) - len(MAGIC) + 1))
            if not source.upto(at + len(MAGIC)):
                return
            continue
        if (at := at + found) >= end:
            return
        if read := read_member(source, at):
            yield read[0], read[1]
            at = read[2]
        else:
            at += 1


def parsed(headers: dict[str, str], block: bytes) -> dict | None:
    """A response or revisit record's fields."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't have its digest")
    number = lambda name: int(x) if (x := headers.get(name, "").strip("<>").removeprefix(_ID)) else None
    return {"page_id": number("warc-record-id"), "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else int(_headers(head)["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to")}


def read_warc(files: DataFrame, payloads: bool = True, split: int = SPLIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the records in (file, size); without payloads that column is null."""
    ship(files.sparkSession)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(file)
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for headers, block in records(Range(source, start), start, start + split):
                        if row := parsed(headers, block):
                            if not payloads:
                                row["payload"] = None
                            rows.append(row)
                            held += len(row["payload"] or b"") + 100
                        if held > READ:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.where("size > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    return ranges.repartition(parts, "file", "start").mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
g AS (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS head FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM g
"""
