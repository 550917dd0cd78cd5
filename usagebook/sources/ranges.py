"""Log files by byte ranges: a file of any size is read by many tasks, and files are named by a table, not by the driver.

A task opens a file at its range and owns the records that start inside. A first
pass counts each range's lines and takes its digest, and reads nothing else out;
running sums of those counts (one row a range) give the second pass the number
of each range's first line, so rows get their line numbers and byte places where
they are read. A compressed file can't be entered in the middle and is one range,
read as a stream; its places are those of the decompressed bytes.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.shipping import ship

#: Bytes of a range, of a read, and of texts in a batch.
RANGE, READ, BATCH = 64 << 20, 1 << 20, 4 << 20
_RANGES = "path string, start long, end long"


def byte_ranges(files: DataFrame, step: int = RANGE) -> DataFrame:
    """(path, start, end) of files (path, size): ranges of `step` bytes, one without an end for a compressed file."""
    size = F.col("size").cast("long")
    whole = F.lower("path").endswith(".zst")
    start = F.explode(F.when(whole | (size <= 0), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(step).cast("long"))))
    cut = files.select("path", size.alias("size"), whole.alias("whole"), start.alias("start"))
    return cut.select("path", "start", F.when(~F.col("whole"), F.least(F.col("start") + step, "size")).alias("end"))


@contextmanager
def opened(path: str, start: int):
    """A stream of a file's bytes from `start` on; of a compressed one decompressed, from its beginning."""
    system, local = fs.FileSystem.from_uri(path)
    if path.lower().endswith(".zst"):
        import zstandard

        with system.open_input_stream(local, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
            yield stream
    else:
        with system.open_input_file(local) as stream:
            stream.seek(start)
            yield stream


def owned(path: str, start: int, end: int | None, digest=None) -> Iterator[tuple[int, int, bytes, bool]]:
    """First byte, end byte, content and completeness of the records that start in a range. digest takes the range's bytes. A record is complete if a line end closes it; of a file's memory no more is held than a record and READ bytes."""
    at = max(0, start - 1)  # a record starts here if the byte before is a line end
    skipping, held, begin, looked = start > 0, bytearray(), at, 0
    with opened(path, at) as stream:
        while True:
            chunk = stream.read(READ)
            if not chunk:
                break
            if digest is not None:
                digest.update(chunk[max(0, start - at) : len(chunk) if end is None else max(0, end - at)])
            at += len(chunk)
            held += chunk
            first = 0
            while (cut := held.find(b"\n", looked)) >= 0:
                if not skipping:
                    yield begin + first, begin + cut + 1, bytes(held[first:cut]), True
                skipping, first, looked = False, cut + 1, cut + 1
                if end is not None and begin + first >= end:
                    return
            begin += first
            del held[:first]
            if skipping:
                begin += len(held)
                held.clear()
                if end is not None and at >= end:
                    return
            looked = len(held)
    if held and not skipping:
        yield begin, begin + len(held), bytes(held), False


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            digest, lines, tail = hashlib.sha256(), 0, None
            for begin, _, _, complete in owned(r["path"], r["start"], r["end"], digest):
                lines += complete
                tail = tail if complete else begin
            out.append(r | {"lines": lines, "tail": tail, "digest": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("lines", pa.int64()), ("tail", pa.int64()), ("digest", pa.string())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("line_number", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("text", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            rows, size, line = [], 0, r["before"]
            for begin, end, raw, complete in owned(r["path"], r["start"], r["end"]):
                if not complete:
                    continue
                line += 1
                rows.append({"path": r["path"], "line_number": line, "byte_start": begin, "byte_end": end, "text": raw.removesuffix(b"\r").decode("utf-8", "replace")})
                size += len(raw)
                if size > BATCH or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_ranges(files: DataFrame, step: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Lines (path, line_number, byte_start, byte_end, text) of files (path, size), and what is known of each range: lines, before (lines of the ranges before it), tail (where an incomplete last line starts), digest.

    A last line without a line end isn't read; a later run finds it complete. An
    empty file has one range without lines (Spark's listing leaves empty files out).
    """
    ship(files.sparkSession)
    dealt = byte_ranges(files, step).repartition("path", "start")
    facts = dealt.mapInArrow(_counted, f"{_RANGES}, lines long, tail long, digest string")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    facts = written(facts.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))), "log-ranges")
    lines = facts.select("path", "start", "end", "before").repartition("path", "start").mapInArrow(_read, "path string, line_number long, byte_start long, byte_end long, text string")
    return lines, facts


def contents(facts: DataFrame) -> DataFrame:
    """(path, content_hash): a digest of the digests of a file's ranges, in order; one for each range's size."""
    parts = F.array_sort(F.collect_list(F.struct("start", "digest")))  # a file's ranges
    return facts.groupBy("path").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["digest"]), "\n"), 256).alias("content_hash"))


__all__ = ["byte_ranges", "contents", "owned", "read_ranges"]
