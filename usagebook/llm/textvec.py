"""Vectorised word scanning over Arrow string columns (numpy, inside tasks).

A batch of texts is one byte buffer with offsets. Words are found with a byte
mask, and every word gets a 64-bit hash from prefix sums of a keyed polynomial,
so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # only some C libraries keep freed memory and can give it back
    _trim = lambda _: 0

#: Bytes of text that are hashed at once; a longer single text is one chunk.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KEYS: dict[int, np.ndarray] = {}
_POWERS: dict[str, np.ndarray] = {}

ASCII_SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(steps)
    return have


def byte_mask(values: bytes) -> np.ndarray:
    """A 256-entry table that is True for the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of runs of whole texts of about `size` bytes. Freed memory goes back to the system, as workers live longer than tasks."""
    i, n = 0, len(offsets) - 1
    _trim(0)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    _trim(0)


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words each text has; no word crosses a text's end."""
    n = len(buf)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _keys(salt: int) -> np.ndarray:
    if salt not in _KEYS:
        _KEYS[salt] = np.random.Generator(np.random.PCG64(20240917 + salt)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
    return _KEYS[salt]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand. Other salts give other functions."""
    n = len(buf)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_keys(salt)[buf] * _powers("up", _BASE, n + 1)[:n], out=sums[1:])
    inverse = _powers("down", _INV, n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_PLACE = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words, for n up to 8, and the place of each n-gram's first word in `hashes`. No n-gram crosses a text's end."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(hashes)) + n <= ends)
    out = np.full(len(at), np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out += mix(hashes[at + k] * _PLACE[k])
    return mix(out), at


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0] + 1, ... for `lengths[0]` of them, then those of the next, and so on."""
    total = int(lengths.sum())
    skips = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts, lengths)
    return np.arange(total, dtype=np.int64) + skips


def spans(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of byte strings, and their starts and ends in it."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends


#: Codes of spans of a buffer, one span after the other, and how many each span has.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def listed(encode: Callable[[list[bytes]], list], dtype: np.dtype) -> Encode:
    """An encoder of spans from one of lists of byte strings."""

    def run(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        found = encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((c for x in found for c in x), dtype, sizes.sum()), sizes

    return run


class SpanTable:
    """Codes of distinct words, kept for later texts; it is emptied when it exceeds `limit` words, so its memory is bounded.

    Words are found by one 64-bit hash and verified by another. Where two words
    share the first, the table starts anew with other hash functions.
    """

    def __init__(self, limit: int, dtype: np.dtype):
        self.limit, self.dtype, self.salt = limit, dtype, 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Encode) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all spans, one after the other, and how many each span has. encode is called for words not met before."""
        checks = hash_spans(buf, starts, ends, self.salt + 1)
        hashes, first, back = np.unique(hash_spans(buf, starts, ends, self.salt), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        new = self.keys[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        own = checks[first]
        if (own[back] != checks).any() or (self.checks[at[~new]] != own[~new]).any():
            self.salt += 2
            self._clear()
            return self.encode(buf, starts, ends, encode)
        if new.any():
            codes, sizes = encode(buf, starts[first[new]], ends[first[new]])
            place = np.searchsorted(self.keys, hashes[new])
            self.starts = np.insert(self.starts, place, len(self.codes) + np.cumsum(sizes) - sizes)
            self.lengths = np.insert(self.lengths, place, sizes)
            self.codes = np.concatenate((self.codes, codes.astype(self.dtype, copy=False)))
            self.checks = np.insert(self.checks, place, own[new])
            self.keys = np.insert(self.keys, place, hashes[new])
            at = np.searchsorted(self.keys, hashes)
        at = at[back]
        return self.codes[expand(self.starts[at], self.lengths[at])], self.lengths[at]
