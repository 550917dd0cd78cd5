"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The benchmark's words are counted over all documents (one row a word and task
   is summed).
2. A seed of SEED words is rare if its words' frequencies let a document hold it
   by chance less often than RARE, or less often than its item's median seed. So
   at least half of an item's seeds are always in use, and how often the item
   itself was copied doesn't matter.
3. In a second scan every rare seed in a document opens a window about the item's
   length on both sides; Smith-Waterman aligns the item with the window (match
   +2, another or a missing word -1). A document holds an item if the best score
   is at least MIN_SCORE of the item's own, so copies with replaced, dropped or
   inserted words are found. Windows are aligned many at a time.

No document is shuffled. Items go to the tasks in blocks of at most BLOCK_BYTES
of text; a larger benchmark takes several scans.

Words are runs of letters, digits and non-ASCII characters, without case (A-Z and
Latin-1). Defined cases: a null or empty text holds nothing; an item of fewer than
MIN_WORDS words has too few seeds to align, so a text holds it where all its words
stand in a row (score 1), which is reported, but as such a phrase is common it
doesn't make a text unclean; an item without words is never reported; items that
repeat are each reported; null ids are passed on; rows that repeat are each
reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import id_and_text, table
from usagebook.llm.textvec import as_bytes, byte_mask, chunks, expand, hash_spans, ngrams, words
from usagebook.shipping import ship

SEED = 3
MIN_WORDS = 5
RARE = 0.001
MIN_SCORE = 0.45
BLOCK_BYTES = 16 << 20
MATCH, MISS = 2, -1
#: Cells of the alignment matrices held at once.
CELLS = 1 << 18

_IS_WORD = byte_mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256)))
_START_BITS = 24


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each text's number of words."""
    low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    low[1:] += np.where((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97), 32, 0).astype(np.uint8)
    starts, ends, counts = words(low, offsets, _IS_WORD)
    return hash_spans(low, starts, ends), starts, ends, counts


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        buf, offsets = as_bytes(pa.array(texts, pa.string()))
        self.ids = ids
        self.words, _, _, self.counts = word_hashes(buf, offsets)
        self.starts = np.cumsum(self.counts) - self.counts
        owners = np.repeat(np.arange(len(self.counts)), self.counts)
        self.vocabulary, self.word = np.unique(self.words, return_inverse=True)
        self.at, self.owner = ngrams(self.words, self.counts, SEED)[1], owners
        long_enough = self.counts[owners[self.at]] >= MIN_WORDS if len(self.at) else np.zeros(0, bool)
        self._index(self.at[long_enough])
        #: For each number of words below MIN_WORDS its items' whole phrases in ascending order, and whose they are.
        self.phrases: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, MIN_WORDS):
            grams, at = ngrams(self.words, self.counts, k)
            own = self.counts[owners[at]] == k
            if own.any():
                order = np.argsort(grams[own], kind="stable")
                self.phrases[k] = grams[own][order], owners[at[own]][order]

    def _index(self, at: np.ndarray) -> None:
        """Takes the seeds that begin at these words."""
        self.at = at
        grams, every = ngrams(self.words, self.counts, SEED)
        seeds = grams[np.searchsorted(every, at)] if len(at) else grams[:0]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.uses = np.diff(np.append(self.first, len(seeds)))
        self.item = self.owner[at][order] if len(at) else at
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def rare(self, counts: np.ndarray, total: int, documents: int) -> None:
        """Keeps the seeds that are rare, given each word's number of uses, that of all words, and that of documents."""
        if not len(self.at):
            return
        share = np.maximum(counts, 1) / max(1, total)
        chance = np.prod([share[self.word[self.at + k]] for k in range(SEED)], axis=0) * total / max(1, documents)
        item = self.owner[self.at]
        order = np.lexsort((chance, item))
        cuts = np.searchsorted(item[order], np.arange(len(self.ids) + 1))
        limit = np.full(len(self.ids), RARE)
        for i in np.flatnonzero(np.diff(cuts)):
            limit[i] = max(RARE, np.median(chance[order[cuts[i] : cuts[i + 1]]]))
        self._index(self.at[chance <= limit[item]])

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams are seeds, and which seeds."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        same = self.seeds[found] == grams[at]
        return at[same], found[same]


def align(items: np.ndarray, item_lengths: np.ndarray, windows: np.ndarray, window_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row's item with its window: score, and the aligned part's start and end in the window.

    Rows are padded. A cell holds the score above START_BITS and below them
    where its alignment began, so one maximum carries both.
    """
    n, width = windows.shape
    one = np.int64(1) << _START_BITS
    column = np.arange(width + 1, dtype=np.int64)
    inside = column[None, 1:] <= window_lengths[:, None]
    fresh = np.broadcast_to(column, (n, width + 1))
    row = fresh.copy()
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    slope = column * one
    for i in range(items.shape[1]):
        same = (windows == items[:, i : i + 1]) & inside
        step = np.maximum(fresh, row + MISS * one)
        step[:, 1:] = np.maximum(step[:, 1:], row[:, :-1] + np.where(same, MATCH * one, MISS * one))
        row = np.maximum(np.maximum.accumulate(step - MISS * slope, axis=1) + MISS * slope, fresh)
        at = (row >> _START_BITS).argmax(1)
        top = row[np.arange(n), at]
        better = ((top >> _START_BITS) > (best >> _START_BITS)) & (i < item_lengths)
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best >> _START_BITS, best & (one - 1), end


def _windows(items: Items, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, first word and length of the windows that seeds open; places count within the chunk's words."""
    grams, at = ngrams(hashes, counts, SEED)
    hit, seed = items.hits(grams)
    uses = items.uses[seed]
    use = expand(items.first[seed], uses)
    place = np.repeat(at[hit], uses)
    text = np.searchsorted(np.cumsum(counts), place, side="right")
    item = items.item[use]
    size = items.counts[item]
    order = np.lexsort((place, item, text))
    text, item, place, size = text[order], item[order], place[order], size[order]
    if not len(text):
        return text, item, place, size
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    # seeds within an item's length share a window; a longer run of them is cut every four lengths
    run_start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    cell = (place - place[run_start]) // (4 * size)
    new[1:] |= (place[1:] - place[:-1] > size[1:]) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    text, item, size = text[first], item[first], size[first]
    ends = np.cumsum(counts)
    pad = size + size // 4 + 2
    low = np.maximum(place[first] - pad, (ends - counts)[text])
    high = np.minimum(place[last] + SEED + pad, ends[text])
    return text, item, low, high - low


def phrases(hashes: np.ndarray, counts: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Text, item, first word and end word of the first place of each short item in each text of the chunk."""
    found = []
    texts = np.repeat(np.arange(len(counts)), counts)
    for k, (known, owner) in items.phrases.items():
        grams, at = ngrams(hashes, counts, k)
        low, high = np.searchsorted(known, grams), np.searchsorted(known, grams, side="right")
        at, item = np.repeat(at, high - low), owner[expand(low, high - low)]
        first = np.unique(texts[at] * len(items.ids) + item, return_index=True)[1]
        found.append((texts[at[first]], item[first], at[first], at[first] + k))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def contaminated(buf: np.ndarray, offsets: np.ndarray, items: Items, short: bool = True) -> tuple[np.ndarray, ...]:
    """Text, item, score, and the passage's first and last byte for each item that a text of the chunk holds; without short only items of MIN_WORDS words or more."""
    hashes, starts, ends, counts = word_hashes(buf, offsets)
    text, item, low, length = _windows(items, hashes, counts)
    score, begin, end = np.zeros(len(text)), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    order = np.lexsort((length, items.counts[item]))
    at = 0
    while at < len(order):
        size = min(len(order) - at, max(1, CELLS // (int(length[order[at]]) + 1)))
        part = order[at : at + size]
        while size > 1 and size * int(length[part].max()) > 2 * CELLS:
            size = size // 2
            part = order[at : at + size]
        at += size
        tall, wide = int(items.counts[item[part]].max()), int(length[part].max())
        column = np.arange(wide)
        rows = np.where(column < length[part][:, None], hashes[np.minimum(low[part][:, None] + column, len(hashes) - 1)], 0)
        column = np.arange(tall)
        own = np.where(column < items.counts[item[part]][:, None], items.words[np.minimum(items.starts[item[part]][:, None] + column, len(items.words) - 1)], 1)
        value, b, e = align(own, items.counts[item[part]], rows, length[part])
        score[part], begin[part], end[part] = value / (MATCH * items.counts[item[part]]), low[part] + b, low[part] + e
    good = np.flatnonzero(score >= MIN_SCORE)
    good = good[np.lexsort((-score[good], item[good], text[good]))]
    new = np.ones(len(good), bool)
    new[1:] = (text[good][1:] != text[good][:-1]) | (item[good][1:] != item[good][:-1])
    good = good[new]
    out = text[good], item[good], score[good], starts[begin[good]], ends[end[good] - 1]
    if short:
        text, item, first, last = phrases(hashes, counts, items)
        out = tuple(np.concatenate(x) for x in zip(out, (text, item, np.ones(len(text)), starts[first], ends[last - 1]), strict=True))
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks of bounded size."""
    rows = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[text].cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = -(-total // BLOCK_BYTES)
    for k in range(number):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text").collect()
        if part:
            yield Items([r["item_id"] for r in part], [r["text"] for r in part])


def rare_seeds(texts: DataFrame, items: Items) -> Items:
    """items, with the seeds that are rare over all texts (doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums, total, rows = np.zeros(len(known) + 1, np.int64), 0, 0
        for batch in batches:
            rows += len(batch)
            for _, _, b, o in chunks(*as_bytes(batch.column(1))):
                hashes = word_hashes(b, o)[0]
                total += len(hashes)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    sums += np.bincount(np.where(known[at] == hashes, at, len(known)), minlength=len(known) + 1)
        used = np.flatnonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(sums[used], [total, rows]))], ["word", "n"])

    counts, total, documents = np.zeros(len(items.vocabulary), np.int64), 0, 0
    for word, n in texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():  # at most a row for each word of the block
        if word == -1:
            total = n
        elif word == -2:
            documents = n
        else:
            counts[word] = n
    items.rare(counts, total, documents)
    return items


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, passage: one row for each item that a document holds."""
    texts = id_and_text(docs, doc_id, text)
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, passage string")
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rare_seeds(texts, items))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            ids = np.array(own.ids, dtype=object)
            for batch in batches:
                for i, _, b, o in chunks(*as_bytes(batch.column(1))):
                    rows, item, score, start, end = contaminated(b, o, own)
                    passages = [b[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start, end, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + rows)), pa.array(ids[item], pa.int64()), pa.array(score), pa.array(passages, pa.string())], ["doc_id", "item_id", "score", "passage"])

        found = found.union(texts.mapInArrow(search, found.schema))
    return found


def texts_of(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, text) where no id is needed."""
    ship(docs.sparkSession)
    return docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item of MIN_WORDS words or more, with all their columns, of any types and in any order."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(rare_seeds(texts_of(docs, text), items))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(len(batch), bool)
                for i, _, b, o in chunks(*as_bytes(batch.column(at))):
                    good[i + contaminated(b, o, shared.value, short=False)[0]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
