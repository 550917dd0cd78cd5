"""Toxicity: a subsequence string kernel with Nystrom landmarks and a linear SVM.

The unit is a word, or a run of words of one character (a spelled-out insult).
The kernel of two units compares their subsequences of three letters that lie
within SPAN letters; a subsequence weighs DECAY for each letter skipped, and
characters that are no letters or digits don't count at all. The kernel is
normalised, so gaps, separators and inserted characters cost little:
`i--d--i--o--t` is `idiot`, and `idddiot` stays close to it. A unit of more than
LONG letters is looked at through windows of WINDOW letters, one every STEP
letters to its end, each normalised by itself; so an insult inside a long run
weighs the same wherever it stands and however long the run is.

Landmarks are units of the training sample, of a unit of more than LONG letters its
windows: those that toxic texts hold far more often than others, and frequent ones of other texts. A
text's kernel with a landmark is that of its closest unit, 0 below FLOOR. Nystrom
features are the kernels with all landmarks times the inverse root of the
landmarks' own kernel matrix; a linear SVM (squared hinge) separates them and a
logistic curve maps its values to scores.

Training uses a bounded sample: the whole texts of about TRAIN_DOCS labelled ids,
of which, where ids repeat or texts are long, a hash of id and text draws such a
share that no more than about TRAIN_DOCS rows and TRAIN_BYTES in all come to the
driver, equal rows once; a text is passed over only where it exceeds what is left
of TRAIN_BYTES. Scoring covers whole texts. A worker process keeps the kernels of
distinct units in a bounded table for all its tasks. Nothing is shuffled but the
labels and the drawn rows.

Defined cases: an empty or null text, or one without landmarks' relatives, gets
the score of that; if nothing can be learned (no label, or only one class) every
score is the share of toxic labels, 0 without any; null ids are passed on;
rows that repeat are each scored; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.llm.shared import id_and_text, table
from usagebook.llm.textvec import ASCII_SPACES, SpanTable, as_bytes, byte_mask, chunks, expand, hash_spans, lower_ascii, spans, words

SPAN = 5
DECAY = 0.6
FLOOR = 0.45
LONG, WINDOW, STEP = 16, 12, 4
TOXIC_LANDMARKS, OTHER_LANDMARKS = 160, 80
TRAIN_DOCS = 8000
TRAIN_BYTES = 48 << 20
#: Distinct units that a process keeps.
UNITS_KEPT = 600_000
#: Units whose kernels are computed at once.
BLOCK = 1024

_IS_WORD = ~byte_mask(ASCII_SPACES)
#: Letters' codes: a-z, 0-9, and the bytes of other characters; 0 matches nothing.
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[128:192] = np.arange(37, 101)
_CODE[192:256] = 101 + np.arange(64) % 27
_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts of the units of lower-cased texts."""
    starts, ends, counts = words(buf, offsets, _IS_WORD)
    if not len(starts):
        return starts, ends, counts
    text = np.repeat(np.arange(len(counts)), counts)
    single = ends - starts == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    starts, ends, text = starts[head], ends[np.append(head[1:], len(ends)) - 1], text[head]
    return starts, ends, np.bincount(text, minlength=len(counts))


def _parts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of units of so many letters, all letters one after the other: each window's first letter, its length, and its unit."""
    parts = np.where(letters > LONG, -(-(letters - WINDOW) // STEP) + 1, 1)
    owner = np.repeat(np.arange(len(letters)), parts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.where(letters > LONG, WINDOW, letters)[owner]
    return (np.cumsum(letters) - letters)[owner] + np.minimum(step * STEP, letters[owner] - size), size, owner


def windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' codes of the units' windows, one window after the other, each window's length, and its unit."""
    lengths = ends - starts
    code, unit = _CODE[buf[expand(starts, lengths)]], np.repeat(np.arange(len(starts)), lengths)
    code, unit = code[code > 0], unit[code > 0]
    first, size, owner = _parts(np.bincount(unit, minlength=len(starts)))
    return code[expand(first, size)], size, owner


def examples(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What units may give as landmarks: a buffer, starts and ends in it, and each one's unit. A unit stands for itself, a longer one than LONG letters for the letters of each of its windows."""
    lengths = ends - starts
    at, unit = expand(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
    letter = _CODE[buf[at]] > 0
    letters = np.bincount(unit[letter], minlength=len(starts))
    short, long = np.flatnonzero(letters <= LONG), np.flatnonzero(letters > LONG)
    if not len(long):
        return buf, starts, ends, np.arange(len(starts))
    first, size, owner = _parts(letters[long])
    first = first + len(buf)
    own = buf[at[letter & (letters > LONG)[unit]]]
    return np.concatenate((buf, own)), np.concatenate((starts[short], first)), np.concatenate((ends[short], first + size)), np.concatenate((short, long[owner]))


def spoken(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether spans have three different letters or more."""
    if not len(starts):
        return np.zeros(0, bool)
    code, first = _CODE[buf[expand(starts, ends - starts)]], np.cumsum(ends - starts) - (ends - starts)
    kinds = np.bitwise_or.reduceat(np.where(code > 0, np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0)), first)
    return np.bitwise_count(kinds) >= 3


def subsequences(code: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, subsequence and summed weight, each pair once, in the order of windows."""
    window = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # letters to the window's end
    keys, weights = [], []
    for a, b in _PATTERNS:
        at = np.flatnonzero(left > b)
        keys.append((window[at] << 21) | (code[at] << 14) | (code[at + a] << 7) | code[at + b])
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 21, key[first] & ((1 << 21) - 1), np.add.reduceat(weight, first) if len(first) else weight


class Landmarks:
    """Landmark units and their normalised subsequence weights, by subsequence."""

    def __init__(self, names: list[bytes]):
        self.names = names
        code, lengths, owner = windows(*spans(names))
        if len(owner) != len(names):
            raise ValueError(f"a landmark has more than {LONG} letters")
        unit, key, weight = subsequences(code, lengths)
        norm = np.sqrt(np.bincount(unit, weight**2, len(names)))
        order = np.argsort(key, kind="stable")
        seen, first = np.unique(key[order], return_index=True)
        self.column = np.full(1 << 21, -1, np.int32)
        self.column[seen] = np.arange(len(seen))
        self.first, self.many = first, np.diff(np.append(first, len(key)))
        self.landmark, self.weight = unit[order], (weight / norm[unit])[order]

    def kernels(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the units' windows: each window's unit, and its kernels with the landmarks (0 where no kernel can reach FLOOR)."""
        many = len(self.names)
        for i in range(0, len(starts), BLOCK):
            code, lengths, owner = windows(buf, starts[i : i + BLOCK], ends[i : i + BLOCK])
            unit, key, weight = subsequences(code, lengths)
            norm = np.sqrt(np.bincount(unit, weight**2, len(owner)))
            column = self.column[key]
            hit = column >= 0
            unit, column, weight = unit[hit], column[hit], weight[hit] / norm[unit[hit]]
            # a window's kernel with anything is at most the length of its part that landmarks share
            near = np.sqrt(np.bincount(unit, weight**2, len(owner)))[unit] >= FLOOR
            unit, column, weight = unit[near], column[near], weight[near]
            rows, back = np.unique(unit, return_inverse=True)
            uses = self.many[column]
            at = expand(self.first[column], uses)
            cell = np.repeat(back * many, uses) + self.landmark[at]
            block = np.bincount(cell, np.repeat(weight, uses) * self.weight[at], len(rows) * many).reshape(-1, many)
            yield i + owner[rows], block

    def close_ones(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The landmarks that each unit has at FLOOR or above, each with its kernel in 1/255, as landmark * 256 + kernel; and how many they are."""
        codes, sizes = [np.zeros(0, np.uint16)], np.zeros(len(starts), np.int64)
        for unit, block in self.kernels(buf, starts, ends):
            row, landmark = np.nonzero(block >= FLOOR)
            codes.append((landmark * 256 + np.minimum(255, np.rint(block[row, landmark] * 255))).astype(np.uint16))
            sizes += np.bincount(unit[row], minlength=len(starts))
        return np.concatenate(codes), sizes

    def features(self, buf: np.ndarray, offsets: np.ndarray, known: SpanTable) -> np.ndarray:
        """Each text's kernels with the landmarks."""
        buf = lower_ascii(buf)
        starts, ends, counts = units(buf, offsets)
        out = np.zeros((len(counts), len(self.names)), np.float32)
        if len(starts):
            codes, sizes = known.encode(buf, starts, ends, self.close_ones)
            text = np.repeat(np.repeat(np.arange(len(counts)), counts), sizes)
            np.maximum.at(out, (text, codes >> 8), (codes & 255).astype(np.float32) / 255)
        return out


class ToxicityModel:
    """Landmarks, the SVM's weights on the kernels with them, and the curve from its values to scores."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.landmarks: Landmarks | None = None
        self.name = uuid.uuid4().hex
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        if not 0 < self.share < 1 or not (names := self._choose(texts, toxic)):
            return
        self.landmarks = Landmarks(names)
        known = SpanTable(UNITS_KEPT, np.uint16)
        rows = [self.landmarks.features(b, o, known) for _, _, b, o in chunks(*as_bytes(pa.array(texts, pa.string())))]
        own = np.zeros((len(names), len(names)))
        for unit, block in self.landmarks.kernels(*spans(names)):
            own[unit] = block
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        x, y = np.concatenate(rows).astype(np.float64) @ root, np.where(toxic, 1.0, -1.0)
        weights, bias = self._svm(x, y)
        self.weights, self.bias = (root @ weights).astype(np.float32), bias
        self.slope, self.shift = self._curve(x @ weights + bias, y)

    @staticmethod
    def _choose(texts: list[str], toxic: np.ndarray) -> list[bytes]:
        """Units that mark toxic texts, by the log-likelihood ratio of their counts of texts, and frequent units of the others."""
        column = pa.array(texts, pa.string())
        unit, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for i, j, b, o in chunks(*as_bytes(column)):
            b = lower_ascii(b)
            starts, ends, many = units(b, o)
            b, starts, ends, unit_of = examples(b, starts, ends)
            found, first, back = np.unique(hash_spans(b, starts, ends), return_index=True, return_inverse=True)
            which, text = np.divmod(np.unique(back * (j - i) + np.repeat(np.arange(j - i), many)[unit_of]), j - i)
            of = np.bincount(which * 2 + toxic[i + text], minlength=2 * len(found)).reshape(-1, 2)
            good = spoken(b, starts[first], ends[first])
            unit, place = np.unique(np.concatenate((unit, found[good])), return_inverse=True)
            both = np.concatenate((counts, of[good]))
            counts = np.stack([np.bincount(place, both[:, k], len(unit)).astype(np.int64) for k in (0, 1)], 1)
        c, a = counts.T
        n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
        rate, p1, p0 = (a + c) / (n1 + n0), a / n1, c / n0
        gain = a * np.log(np.maximum(p1, 1e-12) / rate) + c * np.log(np.maximum(p0, 1e-12) / rate)
        marks = np.flatnonzero((a >= 2) & (p1 > 3 * p0))
        marks = marks[np.lexsort((unit[marks], -gain[marks]))][:TOXIC_LANDMARKS]
        plain = np.flatnonzero(p1 < 1.5 * p0)
        plain = plain[np.lexsort((unit[plain], -c[plain]))][:OTHER_LANDMARKS]
        if not len(marks):
            return []
        names: dict[int, bytes] = {}
        chosen = unit[np.concatenate((marks, plain))]
        for _, _, b, o in chunks(*as_bytes(column)):
            b = lower_ascii(b)
            starts, ends, _ = units(b, o)
            b, starts, ends, _ = examples(b, starts, ends)
            h = hash_spans(b, starts, ends)
            at = np.flatnonzero(np.isin(h, chosen))
            found, first = np.unique(h[at], return_index=True)
            for k, e in zip(found.tolist(), at[first].tolist(), strict=True):
                names.setdefault(k, b[starts[e] : ends[e]].tobytes())
        return [names[h] for h in chosen.tolist()]

    @staticmethod
    def _svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
        """Weights and bias of least squared hinge loss, both classes of equal weight, by accelerated gradient steps."""
        z = np.hstack((x, np.ones((len(x), 1)))) * y[:, None]
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        steepest = 2 * np.linalg.eigvalsh((z * share[:, None]).T @ z)[-1] + strength
        w = ahead = np.zeros(z.shape[1])
        for k in range(rounds):
            slack = np.maximum(0, 1 - z @ ahead)
            new = ahead - (strength * ahead - 2 * z.T @ (share * slack)) / steepest
            w, ahead = new, new + k / (k + 3) * (new - w)
        return w[:-1], float(w[-1])

    @staticmethod
    def _curve(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of the logistic curve that fits the classes, by Newton steps."""
        z, t, s = np.stack((value, np.ones(len(value)))), (y > 0).astype(float), np.zeros(2)
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(s @ z, -30, 30)))
            s = s - np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (p - t) + 1e-6 * s)
        return float(max(s[0], 1e-6)), float(s[1])

    def scores(self, buf: np.ndarray, offsets: np.ndarray, known: SpanTable) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(offsets) - 1, self.share)
        value = self.landmarks.features(buf, offsets, known) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * value.astype(np.float64) + self.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """A model from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    marked = labels.select(labels[doc_id].cast("long").alias("id"), labels[toxic].cast("int").alias("toxic")).where("toxic in (0, 1) and crc32(cast(cast(id as string) as binary)) % 5 <> 0").distinct()
    draw = lambda *by: F.pmod(F.xxhash64(*by, F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.broadcast(marked.where(draw("id") < TRAIN_DOCS / max(1, marked.count())))  # about TRAIN_DOCS rows
    rows = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text")).where("octet_length(text) > 0").join(drawn, "id")
    number, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(TRAIN_DOCS / max(1, number), TRAIN_BYTES / max(1, size))
    drawn = rows.where(draw("id", "text") < share).distinct().orderBy(F.xxhash64("id", "text"), "toxic")
    texts, classes, left = [], [], TRAIN_BYTES
    for r in drawn.select("text", "toxic").toLocalIterator():
        if (size := len(r["text"].encode())) <= left:
            left -= size
            texts.append(r["text"])
            classes.append(r["toxic"] == 1)
    return ToxicityModel(texts, np.array(classes, bool))


#: This process's units by model.
_KNOWN: dict[str, SpanTable] = {}


def known_units(model: ToxicityModel) -> SpanTable:
    """The table that this process keeps for a model, the last one used."""
    if model.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.name] = SpanTable(UNITS_KEPT, np.uint16)
    return _KNOWN[model.name]


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = known_units(own)
        for batch in batches:
            out = [own.scores(b, o, known) for _, _, b, o in chunks(*as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], ["doc_id", "score"])

    return id_and_text(docs, doc_id, text).mapInArrow(score, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
