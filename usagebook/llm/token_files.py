"""Token ids in Arrow files of fixed-size-list batches.

The documents' ids, one document after the other in ascending doc_id order, are
one stream, cut into sequences of LENGTH ids. A file holds the sequences of a
range of documents as two columns, `ids` fixed_size_list<uint16 or uint32>[LENGTH]
and `mask` fixed_size_list<bool>[LENGTH]; the mask is false for the padding of a
file's last sequence. In a memory-mapped file sequence k is a slice of one
buffer, so any sequence is read without copying or decoding. Beside each file a
small index file holds the doc_id and the number of ids of its documents, in
order; and the files' own totals give each document's place in the whole stream.

Documents are range-partitioned by doc_id and sorted; each task encodes its
range and writes it in batches, under a temporary name that is moved to the
final one when complete, so a task that runs again replaces equal files. Words
are encoded once a process as long as its bounded table holds them (white space
separates words in the tokenizer's own rules), and what the tokenizer returns for
them is put together. Reading back,
each task opens files of its own.

Defined cases: a null text has only the end id; rows that repeat a doc_id follow
each other, ordered by a hash of the text; a null doc_id comes first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagebook.llm.shared import full_uri, id_and_text, new_path, stored, table
from usagebook.llm.textvec import ASCII_SPACES, SpanTable, as_bytes, byte_mask, chunks, listed, words

LENGTH = 2048
END_ID = 1
WORDS_KEPT = 1_000_000
#: Sequences in a record batch.
BATCH = 512
#: Bytes of text for each file at least one file; a file is read by one task.
FILE_BYTES = 64 << 20

_IS_WORD = ~byte_mask(ASCII_SPACES)
_LETTER = byte_mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class WordEncoder:
    """A tokenizer of which a process keeps the ids of words met, for its later tasks too.

    Words are cut after a letter before an ASCII character that is none, where
    the tokenizer's pattern always cuts; so a word shares its ids whatever
    follows it. New words are encoded many at a time, between separators that
    are a token of their own; words that hold the separator go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids_type = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known = SpanTable(WORDS_KEPT, self.ids_type)
        self.added = sorted(x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values())
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.separator = next((c for c in "7" if len(ids(c)) == 1 and ids(f"ab {c} cd") == ids("ab") + ids(c) + ids("cd")), None)
        self.separator_id = ids(self.separator)[0] if self.separator else -1

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids end."""
        starts, ends, counts = words(buf, offsets, _IS_WORD)
        if not len(starts):
            return np.zeros(0, self.ids_type), np.zeros(len(counts), np.int64)
        raw = buf.tobytes()
        if not any(x in raw for x in self.added):  # an added token holds such a place
            cut = np.flatnonzero(_LETTER[buf[:-1]] & ~_LETTER[buf[1:]] & (buf[1:] < 128) & _IS_WORD[buf[1:]]) + 1
            first = np.zeros(len(buf) + 1, bool)
            first[offsets] = True
            cut = cut[~first[cut]]
            counts = counts + np.diff(np.searchsorted(cut, offsets))
            starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        ids, sizes = self.known.encode(buf, starts, ends, listed(self._encode, self.ids_type))
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]

    def _encode(self, raw: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(raw)
        texts = [w.decode("utf-8", "replace") for w in raw]
        single = [k for k, t in enumerate(texts) if self.separator is None or self.separator in t or len(t) > 200 or "<" in t]
        for k in single:
            out[k] = self.tokenizer.encode(texts[k], add_special_tokens=False).ids
        joined = sorted(set(range(len(texts))) - set(single))
        for i in range(0, len(joined), 4096):
            part = joined[i : i + 4096]
            ids = self.tokenizer.encode(f" {self.separator} ".join(texts[k] for k in part), add_special_tokens=False).ids
            cuts = np.flatnonzero(np.array(ids) == self.separator_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer doesn't keep words apart")
            begin, end = np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist()
            for k, b, e in zip(part, begin, end, strict=True):
                out[k] = ids[b:e]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """A stream of ids as a file of fixed-size-list batches, with its index."""

    def __init__(self, path: str, ids: np.dtype, length: int):
        self.system, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.ids, self.length = np.dtype(ids), length
        value = pa.uint16() if self.ids.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.system.open_output_stream(self.temporary)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.total = np.zeros(0, self.ids), 0
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.total += len(ids)
        self.rest = np.concatenate((self.rest, ids.astype(self.ids)))
        block = self.length * BATCH
        while len(self.rest) >= block:
            self._write(self.rest[:block], block)
            self.rest = self.rest[block:]

    def _write(self, ids: np.ndarray, used: int) -> None:
        n = -(-len(ids) // self.length) * self.length
        padded = np.zeros(n, self.ids)
        padded[: len(ids)] = ids
        values = [pa.array(padded, self.schema.field(0).type.value_type), pa.array(np.arange(n) < used)]
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, self.length) for v in values], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest, len(self.rest))
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.chunked_array(self.doc_ids, pa.int64()), "n_tokens": pa.array(np.concatenate([np.zeros(0, np.int64), *self.counts]))})
        with self.system.open_output_stream(f"{self.temporary}.index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        self.system.move(f"{self.temporary}.index", f"{self.path}.index")
        self.system.move(self.temporary, self.path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes the files and returns (part, file, n_tokens), one row a file, in the stream's order of parts."""
    model = tokenizer or default_tokenizer()
    folder = full_uri(docs.sparkSession, path.rstrip("/"))
    system, local = _open(folder)
    system.create_dir(local, recursive=True)
    texts = id_and_text(docs, doc_id, text)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(model)
        ids_type = np.dtype(np.uint32) if end_id >= 1 << 16 else encoder.ids_type
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}.arrow"
        writer: Writer | None = None
        for batch in batches:
            buf, offsets = as_bytes(batch.column(1))
            for i, j, b, o in chunks(buf, offsets):
                writer = writer or Writer(file, ids_type, length)
                ids, cuts = encoder.encode(b, o)
                writer.add(batch.column(0).slice(i, j - i), np.insert(ids.astype(ids_type, copy=False), cuts, ids_type.type(end_id)), np.diff(np.concatenate(([0], cuts))) + 1)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_tokens": writer.total}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64())]))

    # boundaries are sampled: ids and hashes, not texts; the number of the row divides rows that repeat both
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("number")]
    ranged = texts.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.mapInArrow(write, "part int, file string, n_tokens long"), "token-files")


def open_sequences(file: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader; in a local file's batches the columns are views of the mapped file."""
    system, path = _open(file)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, path = _open(file)
            with system.open_input_file(f"{path}.index") as source:
                index = pa.ipc.open_file(source).read_all().combine_chunks()
            counts = index.column("n_tokens").to_numpy()
            cuts = np.concatenate(([0], np.cumsum(counts)))
            reader = open_sequences(file)
            crcs, doc, at = np.zeros(len(counts), np.int64), 0, 0
            for k in range(reader.num_record_batches):
                block = reader.get_batch(k)
                used = int(block.column(1).flatten().true_count)
                ids = block.column(0).flatten().to_numpy()[:used].astype("<u4")
                # the documents that reach into this batch; a checksum goes on where a batch ends
                while doc < len(counts) and cuts[doc] < at + used:
                    part = ids[max(0, cuts[doc] - at) : cuts[doc + 1] - at]
                    crcs[doc] = zlib.crc32(part.tobytes(), int(crcs[doc]))
                    if cuts[doc + 1] > at + used:
                        break
                    doc += 1
                at += used
            for i in range(0, len(counts), 50_000):
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks().slice(i, 50_000) if isinstance(index.column("doc_id"), pa.ChunkedArray) else index.column("doc_id").slice(i, 50_000), pa.array(base + cuts[:-1][i : i + 50_000]), pa.array(counts[i : i + 50_000]), pa.array(crcs[i : i + 50_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that write_token_files returned."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.count())
    return based.repartition(parts, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-stream")))
