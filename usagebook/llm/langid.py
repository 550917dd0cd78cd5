"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of 0 to ORDER bytes is counted from a
bounded sample of labelled texts. A symbol's probability is its share in the
longest context met (escape method C, with exclusion), else the escape
probability times the share in the next shorter context, down to a uniform
distribution over the 256 bytes; the probabilities of a context sum to 1, so the
code lengths are exact. The statistics are frozen before scoring: the code
length of every (context, symbol) is tabled once, and a text costs one table
look-up a byte. Bytes A-Z count as a-z. Bytes never met in training share one
symbol, which loses nothing: such a byte always costs all escapes, and no
context that holds it was met.

Statistics are kept by met (context, symbol) pairs, so a model is no larger than
its training bytes, whatever the number of languages. Where the table of all
contexts' symbols in all languages fits TABLE_BYTES it is written out, which saves
searches and changes no value.

Training: whole texts of every language, drawn by a hash of doc_id and text in such
a share that about DOCS_PER_LANGUAGE rows of each language, and no more than about
TRAIN_BYTES in all, come to the driver, equal rows once; a text is passed over
only where it exceeds what is left of its language's part of TRAIN_BYTES and the
language has another text already.

Defined cases: a text that is null or has no letter is `und` with score 0; so is
every text if nothing can be learned; null ids are allowed; every row gives one
row, in an empty table none; a null lang is not learned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import id_and_text, stored, table
from usagebook.llm.textvec import as_bytes, chunks, lower_ascii
from usagebook.shipping import ship

ORDER = 3
DOCS_PER_LANGUAGE = 600
TRAIN_BYTES = 32 << 20
TABLE_BYTES = 64 << 20
#: Languages up to which their shares are broadcast; beyond, Spark chooses the join.
BROADCAST_LANGUAGES = 100_000


def grid(bits: np.ndarray) -> np.ndarray:
    """Bits in whole 4096ths, which single precision holds, so that sums are exact and don't depend on how the bits were found."""
    return np.rint(bits * 4096) / 4096


class ContextTrees:
    """Frozen PPM statistics of several languages."""

    def __init__(self, texts: list[tuple[str, str]]):
        """texts: (language, text)."""
        self.languages = sorted({lang for lang, _ in texts})
        raw = {k: as_bytes(pa.array([t for lang, t in texts if lang == k], pa.string())) for k in self.languages}
        seen = sorted({32}.union(*(np.unique(lower_ascii(b)).tolist() for b, _ in raw.values())))
        self.size = len(seen) + 1
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, self.size)
        for upper in range(65, 91):
            self.code[upper] = self.code[upper + 32]
        self.orders = [self._count(*self._grams(*raw.pop(k))) for k in self.languages]
        self.longest, self.bits = self._written_out()

    def __getstate__(self) -> dict:
        """Where the table is written out, workers need no pairs."""
        return self.__dict__ | ({} if self.longest is None else {"orders": []})

    def _grams(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each byte's symbol and its context of ORDER bytes as a number, whose remainders are the shorter contexts; before a text stand spaces."""
        symbol = self.code[buf]
        starts = offsets[:-1][np.diff(offsets) > 0]
        last, number, weight = symbol, np.zeros(len(symbol), np.int64), 1
        for _ in range(ORDER):
            before = np.empty_like(last)
            before[1:] = last[:-1]
            if len(before):
                before[starts] = self.code[32]
            number += before * weight
            weight *= self.size
            last = before
        return symbol, number

    def _count(self, symbol: np.ndarray, context: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each order the met (context, symbol) pairs with their bits, and the met contexts with those of their escapes; bits are negative."""
        out, a = [], self.size
        for order in range(ORDER + 1):
            pair, counts = np.unique(context % a**order * a + symbol, return_counts=True)
            met, of = np.unique(pair // a, return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            below = np.exp2(out[-1][1][np.searchsorted(out[-1][0], pair % a**order)]) if order else np.full(len(pair), 1 / 256)  # met in the shorter context, too
            left = 1 - np.bincount(of, below)
            escape = kinds / ((total + kinds) * np.maximum(left, 1e-12))
            out.append((pair, np.log2(counts / (total + kinds)[of]), met, np.log2(escape)))
        return out

    def _code_bits(self, language: int, code: np.ndarray) -> np.ndarray:
        """The bits of symbols after contexts, given as context * size + symbol in ascending order."""
        a, bits, open_ = self.size, np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            pair, worth, met, escape = self.orders[language][order]
            own = code[open_] % a ** (order + 1)
            at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            found = pair[at] == own
            bits[open_[found]] += worth[at[found]]
            open_, own = open_[~found], own[~found] // a
            at = np.minimum(np.searchsorted(met, own), len(met) - 1)
            known = met[at] == own
            bits[open_[known]] += escape[at[known]]
        bits[open_] -= 8
        return bits

    def _written_out(self) -> tuple[np.ndarray | None, list[np.ndarray]]:
        """The row of each context's longest part met in any language, and each language's bits by row and symbol; none if they don't fit."""
        a, met = self.size, [np.unique(np.concatenate([own[order][2] for own in self.orders])) for order in range(ORDER + 1)]
        rows = sum(map(len, met))
        if 4 * (rows * a * len(self.languages) + a**ORDER) > TABLE_BYTES:
            return None, []
        longest, first, bits = np.zeros(a**ORDER, np.int32), 0, [np.zeros((rows, a), np.float32) for _ in self.languages]
        for order, contexts in enumerate(met):
            for block in longest.reshape(-1, a**order):
                block[contexts] = first + np.arange(len(contexts))
            for k in range(len(self.languages)):
                # a longer context that no language has met costs nothing, so the rest may be one that no text has
                table = grid(self._context_bits(k, contexts, order))
                bits[k][first : first + len(contexts)] = table
            first += len(contexts)
        return longest, [b.ravel() for b in bits]

    def _context_bits(self, language: int, contexts: np.ndarray, order: int) -> np.ndarray:
        """The bits of every symbol after contexts of an order."""
        a, own = self.size, self.orders[language][order]
        if order:
            shorter, back = np.unique(contexts % a ** (order - 1), return_inverse=True)
            out = self._context_bits(language, shorter, order - 1)[back]
        else:
            out = np.full((len(contexts), a), -8.0)
        at = np.minimum(np.searchsorted(own[2], contexts), len(own[2]) - 1)
        out += np.where(own[2][at] == contexts, own[3][at], 0)[:, None]
        row = np.minimum(np.searchsorted(contexts, own[0] // a), len(contexts) - 1)
        mine = contexts[row] == own[0] // a
        out[row[mine], own[0][mine] % a] = own[1][mine]
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Minus the code length in bits of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.diff(offsets) > 0
        if not full.any():
            return out
        symbol, context = self._grams(buf, offsets)
        if self.longest is not None:
            at = self.longest[context].astype(np.int64) * self.size + symbol
            worth = lambda k: self.bits[k][at]
        else:
            code, at = np.unique(context * self.size + symbol, return_inverse=True)
            worth = lambda k: grid(self._code_bits(k, code))[at]
        for k in range(len(self.languages)):
            out[full, k] = np.add.reduceat(worth(k), offsets[:-1][full], dtype=np.float64)
        return out


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ContextTrees | None:
    """Trees from labelled rows whose crc32(doc_id as text) mod 4 is not 2; None if there are none."""
    rows = docs.select(docs[doc_id].cast("string").alias("id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("lang is not null and crc32(cast(id as binary)) % 4 <> 2")
    chance = F.pmod(F.xxhash64("id", "text", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where("octet_length(text) > 0").withColumn("chance", chance)
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("chance").alias("least")), "languages")
    many = sizes.count()
    part = TRAIN_BYTES / max(1, many)
    shares = sizes.select(F.col("lang").alias("_lang"), F.greatest("least", F.least(DOCS_PER_LANGUAGE / F.col("n"), part / F.col("size"))).alias("share"))
    if many <= BROADCAST_LANGUAGES:
        shares = F.broadcast(shares)
    drawn = rows.join(shares, (F.col("lang") == F.col("_lang")) & (F.col("chance") <= F.col("share")))
    texts, left = [], {}
    for r in drawn.select("lang", "text", "chance", "id").distinct().orderBy("lang", "chance", "id", "text").select("lang", "text").toLocalIterator():
        size = len(r["text"].encode())
        if r["lang"] not in left or size <= left[r["lang"]]:
            left[r["lang"]] = left.get(r["lang"], part) - size
            texts.append((r["lang"], r["text"]))
    return ContextTrees(texts) if texts else None


def decide(model: ContextTrees | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the place of its language, -1 without one, and its score."""
    picked, scores = np.full(len(column), -1), np.zeros(len(column))
    for i, j, b, o in chunks(*as_bytes(column)) if model else ():
        bits = model.lengths(b, o)
        sure = 1 / np.exp2(np.maximum(bits - bits.max(1, keepdims=True), -1000)).sum(1)
        ascii_letters = np.concatenate(([0], np.cumsum(((b | 32) >= 97) & ((b | 32) <= 122))))
        spoken = np.diff(ascii_letters[o]) > 0
        for k in np.flatnonzero(~spoken & (np.diff(o) > 0)):
            spoken[k] = has_letter(b[o[k] : o[k + 1]].tobytes())
        picked[i:j] = np.where(spoken, bits.argmax(1), -1)
        scores[i:j] = np.where(spoken, sure, 0)
    return picked, scores


def predict(docs: DataFrame, trees: ContextTrees | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*(model.languages if model else []), "und"], dtype=object)
        for batch in batches:
            picked, scores = decide(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[picked], pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs, doc_id, text).mapInArrow(score, "doc_id long, lang_pred string, score double")


def identified_documents(docs: DataFrame, trees: ContextTrees | None, text: str = "text") -> DataFrame:
    """The rows of docs that get a language, with all their columns; every row if no language was learned."""
    if trees is None:
        return docs
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(shared.value, batch.column(at))[0] >= 0))

    return docs.mapInArrow(keep, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False)).alias("held_out"), "lang_pred", "score")
