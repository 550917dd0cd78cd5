"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a run of spaces, shown as U+2581, and what
follows up to the next space); no piece of the vocabulary holds a mark after
another character, so the cuts change nothing. Nor do cuts between two ASCII
characters that no piece holds beside each other, or around characters that no
piece holds, such as line ends. A task sorts the distinct words it meets and
walks them depth-first as a trie: the forward state of a prefix is computed once
for all words that begin with it.

The forward state of a prefix is the best path to its end: its score, its last
piece and where that piece begins. For a unigram model the best path is the one
with the greatest sum of scores. For a BPE model sums of scores are not what the
tokenizer maximises, so an arc may only follow a piece that BPE would leave
beside it (merging the two pieces' characters gives the two pieces again). Since
BPE never merges across a final boundary, exactly one path survives, and it is
the tokenizer's own result.

Words met are kept in a bounded table for the process's later texts. Nothing is
shuffled. Defined cases: a null or empty text has no ids; a character outside
the vocabulary becomes its UTF-8 bytes (or the unknown id if the model has no
byte pieces); U+2581 in a text decodes as a space, as in SentencePiece itself;
null ids are passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagebook.llm.shared import id_and_text, table
from usagebook.llm.textvec import SpanTable, as_bytes, chunks, expand, listed

MARK = "▁"
#: Distinct words that a process keeps.
WORDS_KEPT = 400_000
#: Pairs of pieces of which a task remembers whether they fit.
FITS_KEPT = 300_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A SentencePiece vocabulary, and the walk that encodes sorted words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.names = {i: p for p, i in self.ids.items()}
        self.scores = {i: sp.get_score(i) for i in self.ids.values()}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.marked = len(sp.encode("a", out_type=str)[0]) > 1 or sp.encode("a", out_type=str)[0] == MARK
        held = set("".join(self.ids))
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in held for b in range(256)])
        # ASCII characters (and the mark) that stand beside each other in no piece: no piece crosses between them
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for piece in self.ids:
            for x, y in zip(piece, piece[1:], strict=False):
                x, y = (32 if c == MARK else ord(c) for c in (x, y))
                if x < 128 and y < 128:
                    self.apart[x, y] = False
        # a byte-pair model ranks pieces by the order of their merges: scores step down by one
        plain = [self.scores[i] for i in sorted(self.scores) if self.scores[i] > -1e8]
        self.bpe = all(float(s).is_integer() for s in plain)
        raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.piece_lengths = np.array([len(x) for x in raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by definition: join the neighbours whose piece scores highest, the leftmost first, until none can be joined."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, piece: int, names: tuple[str, str]) -> bool:
        """Whether a piece may follow the one before (names: both as text, the first empty at a word's start)."""
        key = before * 2_000_003 + piece
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > FITS_KEPT:
                self._fits.clear()
            known = self._fits[key] = self.merged(names[0] + names[1]) == [*names][not names[0] :]
        return known

    def walk(self, words: list[str]) -> Iterator[tuple[int, list[int], list[str], list[int]]]:
        """Forward states of each word's prefixes: where the last piece begins, its text and its id (below 0 for a character that is no piece). In sorted order a word shares the states of the prefix it has in common with the one before, whose length comes first."""
        get, fits, longest, scores, bpe = self.ids.get, self.fits, self.longest, self.scores, self.bpe
        score, begin, last, ident = [0.0], [0], [""], [-1]
        before = ""
        for word in words:
            n = len(word)
            same = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            del score[same + 1 :], begin[same + 1 :], last[same + 1 :], ident[same + 1 :]
            for end in range(same + 1, n + 1):
                best, at, of, number = -np.inf, end - 1, word[end - 1], -1
                for start in range(max(0, end - longest), end):
                    found = get(piece := word[start:end])
                    if found is None:
                        continue
                    if bpe:
                        if fits(ident[start], found, (last[start], piece)):
                            best, at, of, number = score[start] + scores[found], start, piece, found
                            break
                    elif (s := score[start] + scores[found]) > best:
                        best, at, of, number = s, start, piece, found
                if number < 0:  # a character that is no piece
                    best, number = score[at] - 1e6, -2 - ord(of)
                score.append(best)
                begin.append(at)
                last.append(of)
                ident.append(number)
            yield same, begin, last, ident
            before = word

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, sorted words given."""
        out = []
        for word, (_, begin, last, ident) in zip(words, self.walk(words), strict=True):
            codes, end = [], len(word)
            while end:
                if ident[end] >= 0:
                    codes.append(ident[end])
                else:
                    raw = last[end].encode("utf-8", "replace")
                    codes += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown]
                end = begin[end]
            out.append(codes[::-1])
        return out

    def count_sorted(self, words: list[str]) -> list[list[int]]:
        """The number of ids of every prefix of each word, sorted words given: one more than that of the prefix before its last piece."""
        counts, out = [0], []
        for word, (same, begin, last, ident) in zip(words, self.walk(words), strict=True):
            del counts[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                more = 1 if ident[end] >= 0 or not self.bytes else len(last[end].encode("utf-8", "replace"))
                counts.append(counts[begin[end]] + more)
            out.append(counts[1:])
        return out

    def encode_words(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of distinct words given as bytes, in their order."""
        words = [w.decode("utf-8", "replace").replace(" ", MARK) for w in raw]
        order = sorted(range(len(words)), key=words.__getitem__)
        found = self.encode_sorted([words[k] for k in order])
        out: list[list[int]] = [[]] * len(words)
        for k, codes in zip(order, found, strict=True):
            out[k] = codes
        return out

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a mark before each text, and starts, ends and counts of the marked words."""
        full = np.diff(offsets) > 0
        if self.marked:
            buf = np.insert(buf, offsets[:-1][full], np.uint8(32))
            offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        space = buf == 32
        if len(buf) > 2:
            space[2:] |= (buf[2:] == 0x81) & (buf[1:-1] == 0x96) & (buf[:-2] == 0xE2)
        alone = self.alone[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[:-1] = alone | (buf == 32)
        cut[1:-1] &= ~((buf[1:] == 32) & space[:-1])
        cut[1:] |= alone
        cut[1:-1] |= self.apart[buf[:-1], buf[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        return buf, starts, np.append(starts[1:], len(buf)) if len(starts) else starts, np.diff(np.searchsorted(starts, offsets))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and offsets from their ids."""
        lengths = self.piece_lengths[ids]
        out = self.piece_bytes[expand(self.piece_starts[ids], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        drop = np.zeros(len(out) + 1, bool)
        if self.marked:
            first = ends[:-1][np.diff(ends) > 0]
            drop[first] = out[first] == 32
        return out[~drop[:-1]], ends - np.concatenate(([0], np.cumsum(drop)))[ends]


_KNOWN: dict[str, tuple[Pieces, SpanTable]] = {}


def known_pieces(path: str) -> tuple[Pieces, SpanTable]:
    """This process's vocabulary for a model file, and the words met with it."""
    if path not in _KNOWN:
        _KNOWN[path] = Pieces(path), SpanTable(WORDS_KEPT, np.int32)
    return _KNOWN[path]


def id_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) becomes (doc_id, ids, ...)."""
    pieces, known = known_pieces(path)
    for batch in batches:
        for i, j, b, o in chunks(*as_bytes(batch.column(1))):
            b, starts, ends, counts = pieces.spans(b, o)
            codes, sizes = known.encode(b, starts, ends, listed(pieces.encode_words, np.int32)) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            sums = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
            names = [batch.schema.names[0], "ids", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), id_lists(codes, np.diff(sums)), *(c.slice(i, j - i) for c in batch.columns[2:])], names)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(), counts


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, ...) becomes (doc_id, text, ...)."""
    pieces, _ = known_pieces(path)
    for batch in batches:
        out, offsets = pieces.decode(*_lists(batch.column(1)))
        raw = out.tobytes()
        texts = pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], [batch.schema.names[0], "text", *batch.schema.names[2:]])


DIGESTS = ("n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32")


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, ...) becomes doc_id, the digests of the ids and of the text decoded from them, and the rest."""
    pieces, _ = known_pieces(path)
    crc = lambda v, at: pa.array([zlib.crc32(v[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
    for batch in batches:
        ids, counts = _lists(batch.column(1))
        out, offsets = pieces.decode(ids, counts)
        raw, wide, cuts = memoryview(out.tobytes()), memoryview(ids.astype("<u4").tobytes()), np.concatenate(([0], np.cumsum(counts))) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), crc(wide, cuts), pa.array(np.diff(offsets)), crc(raw, offsets), *batch.columns[2:]], [batch.schema.names[0], *DIGESTS, *batch.schema.names[2:]])


def _with_second(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """df's schema with other fields in the place of the second."""
    return T.StructType([df.schema.fields[0], *fields, *df.schema.fields[2:]])


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text, ...) becomes (doc_id, ids, ...)."""
    path = model or default_model()
    return docs.mapInArrow(lambda batches: _encoded(batches, path), _with_second(docs, _IDS))


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, ...) becomes (doc_id, text, ...)."""
    path = model or default_model()
    return encoded.mapInArrow(lambda batches: _decoded(batches, path), _with_second(encoded, T.StructField("text", T.StringType())))


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes (doc_id, text, ...), decodes the ids again, and gives doc_id, n_tokens, ids_crc32, decoded_bytes, decoded_crc32 and the other columns."""
    path = model or default_model()
    return docs.mapInArrow(lambda batches: _digests(_encoded(batches, path), path), _with_second(docs, *[T.StructField(n, T.LongType()) for n in DIGESTS]))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its ids' number and crc32, the decoded text's bytes and crc32, and whether that is the text's own crc32."""
    docs = id_and_text(table(spark, sf_dir, "documents"))
    found = digest_documents(docs.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))))
    return found.withColumn("round_trip", F.col("decoded_crc32") == F.col("text_crc32")).drop("text_crc32")
