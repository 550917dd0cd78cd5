"""Exact token counts of every prefix, by dynamic programming over prefixes.

A text's token count is that of its words (pieces.py cuts them so that no token
crosses a cut) and a word's prefixes are counted by the forward states of the
shared-prefix walk: a prefix has one token more than the prefix before its last
token. So one walk over the distinct words of a task gives, for every character
of every text, the number of tokens that the text up to there has when it is
encoded by itself: the count of the words before it, a running sum, plus the
count within its word. It is no estimate and no re-encoding; where a word goes
on, its count may fall again, as a longer token replaces several.

`count_tokens` reads off the last prefix, and the longest one within a budget.
`prefix_index` stores the counts in blocks of BLOCK bytes, with each block's least
count, and from that table `tokens_before` (how many tokens have the first n
bytes?) and `longest_prefix` (where to cut for a budget?) are answered by joins,
with no text and no tokenizer.

Nothing is shuffled to count. A worker process keeps the counts of distinct words in
a bounded table.

Defined cases: a null or empty text has no tokens, and no rows in the index; a prefix that ends inside a
character has no count (null); rows that repeat doc_id and text are one text in
the index, and texts that share a doc_id are told apart by text_hash, of which
each is answered; null ids are counted but can't be asked for; a very long text
is held once in a task, its index is many blocks; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.pieces import WORDS_KEPT, Pieces, default_model
from usagebook.llm.shared import id_and_text, table
from usagebook.llm.textvec import SpanTable, as_bytes, chunks, expand, listed

LIMIT = 4096
#: Bytes of a text that a row of the index holds.
BLOCK = 4096
#: Counts (one a byte of distinct words) that a process keeps.
COUNTS_KEPT = 8_000_000


def word_counts(pieces: Pieces, raw: list[bytes]) -> list[list[int]]:
    """For each byte of each distinct word the tokens of the word up to it, 0 inside a character."""
    plain = [w.decode("utf-8", "replace") for w in raw]
    words = [w.replace(" ", "▁") for w in plain]
    order = sorted(range(len(words)), key=words.__getitem__)
    out: list[list[int]] = [[]] * len(words)
    for k, counts in zip(order, pieces.count_sorted([words[k] for k in order]), strict=True):
        if len(raw[k]) == len(counts):
            out[k] = counts
            continue
        own = [n for c, x in zip(plain[k], counts, strict=True) for n in (*[0] * (len(c.encode()) - 1), x)]
        out[k] = own if len(own) == len(raw[k]) else [*[0] * (len(raw[k]) - 1), counts[-1]]  # not UTF-8: no prefix but the whole
    return out


class PrefixCounter:
    """The counts of all prefixes of texts, with the words that this process has met."""

    def __init__(self, model: str):
        self.pieces, self.known = Pieces(model), SpanTable(WORDS_KEPT, np.int32)
        self.encode = listed(lambda raw: word_counts(self.pieces, raw), np.int32)

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte of the texts the tokens of its text up to it, 0 inside a character."""
        if not len(buf):
            return np.zeros(0, np.int64)
        if len(self.known.codes) > COUNTS_KEPT:
            self.known = SpanTable(WORDS_KEPT, np.int32)
        marked, starts, ends, many = self.pieces.spans(buf, offsets)
        within, _ = self.known.encode(marked, starts, ends, self.encode)
        whole = within[ends - 1].astype(np.int64)
        sums = np.cumsum(whole) - whole
        first = np.cumsum(many) - many  # each text's first word
        base = sums - np.repeat(np.where(many > 0, sums[np.minimum(first, len(sums) - 1)], 0), many)
        out = np.where(within > 0, within + np.repeat(base, ends - starts), 0)
        if not self.pieces.marked:
            return out
        full = np.diff(offsets) > 0
        at = offsets[:-1][full] + np.arange(full.sum())  # the marks that spans put before texts
        return np.delete(out, at)


_KNOWN: dict[str, PrefixCounter] = {}


def known_counter(path: str) -> PrefixCounter:
    if path not in _KNOWN:
        _KNOWN[path] = PrefixCounter(path)
    return _KNOWN[path]


def count_tokens(docs: DataFrame, limit: int = LIMIT, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes (of the longest prefix with no more than `limit` tokens): one row for each row of docs."""
    path = model or default_model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = known_counter(path)
        for batch in batches:
            for i, j, b, o in chunks(*as_bytes(batch.column(1))):
                counts, size = counter.counts(b, o), np.diff(o)
                tokens, cut = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                full = size > 0
                tokens[full] = counts[o[1:][full] - 1]
                fits = np.flatnonzero((counts > 0) & (counts <= limit))
                last = np.searchsorted(fits, o[1:]) - 1  # the last fitting byte before each text's end
                found = (last >= 0) & full
                found[found] = fits[last[found]] >= o[:-1][found]
                cut[found] = fits[last[found]] + 1 - o[:-1][found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(tokens), pa.array(tokens > limit), pa.array(cut)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return id_and_text(docs, doc_id, text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def prefix_index(docs: DataFrame, model: str | None = None, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, block, first (its bytes' offset), least (count in it), counts (for each byte; 0 inside a character): the counts of every prefix of every text."""
    path = model or default_model()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = known_counter(path)
        for batch in batches:
            for i, j, b, o in chunks(*as_bytes(batch.column(1))):
                counts, size = counter.counts(b, o), np.diff(o)
                blocks = -(-size // block)
                owner = np.repeat(np.arange(j - i), blocks)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                first = o[owner] + number * block
                many = np.minimum(block, o[owner + 1] - first)
                least = np.minimum.reduceat(np.where(counts > 0, counts, np.iinfo(np.int64).max), first) if len(owner) else first
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(counts[expand(first, many)], pa.int32()))
                own = batch.slice(i, j - i).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(number, pa.int64()), pa.array(number * block, pa.int64()), pa.array(least, pa.int64()), lists], ["doc_id", "text_hash", "block", "first", "least", "counts"])

    rows = id_and_text(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(index, "doc_id long, text_hash long, block long, first long, least long, counts array<int>")


def tokens_before(index: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, text_hash, n_tokens: the tokens of the first n_bytes of the texts asked for (doc_id, n_bytes of 1 or more); null inside a character, no row past a text's end."""
    at = asked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes")).distinct().withColumn("block", F.expr(f"(n_bytes - 1) div {block}"))
    found = index.join(at, ["doc_id", "block"]).withColumn("n_tokens", F.get("counts", (F.col("n_bytes") - 1 - F.col("first")).cast("int")))
    return found.where("n_tokens is not null").select("doc_id", "n_bytes", "text_hash", F.expr("nullif(n_tokens, 0)").cast("long").alias("n_tokens")).distinct()


def longest_prefix(index: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, budget, text_hash, n_bytes, n_tokens: the longest prefix of at most `budget` tokens of the texts asked for (doc_id, budget), of 0 bytes where none has any."""
    at = asked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("budget").cast("long").alias("budget")).distinct()
    # the last block with any such prefix holds the longest one, so one block of a text is looked into
    ways = index.join(at, "doc_id").withColumn("fits", F.col("least") <= F.col("budget"))
    last = ways.groupBy("doc_id", "budget", "text_hash").agg(F.max_by(F.when(F.col("fits"), F.struct("first", "counts")), F.when(F.col("fits"), F.col("first"))).alias("b"))
    ends = F.transform("b.counts", lambda c, k: F.when((c > 0) & (c <= F.col("budget")), F.struct((k + 1).alias("k"), c.alias("c"))))
    best = F.array_max(ends)
    return last.withColumn("best", best).select(
        "doc_id", "budget", "text_hash", F.coalesce(F.col("b.first") + F.col("best.k"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col("best.c"), F.lit(0)).cast("long").alias("n_tokens")
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, whether it exceeds LIMIT tokens, and where it would have to be cut."""
    return count_tokens(table(spark, sf_dir, "documents"))
