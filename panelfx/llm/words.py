"""Vectorised word handling inside Arrow tasks.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything works on the
UTF-8 buffer of a string column, so a batch of texts costs a few NumPy passes
and no Python object per word.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME
SLICE_BYTES = 2 << 20  # texts that a task handles at once: some 40 bytes of arrays per byte


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back_memory() -> None:
    """Return freed memory to the system: workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing to trim


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME (2**61 counts as 1)."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo PRIME, of values below it, by halves of 32 bits."""
    half, low, part = U64(32), U64((1 << 32) - 1), U64((1 << 29) - 1)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_high * b_low + a_low * b_high
    return reduced((a_high * b_high << U64(3)) + (middle >> U64(29)) + ((middle & part) << half) + reduced(a_low * b_low))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo PRIME, by doubling."""
    out = np.ones(max(n, 1), U64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = product(out[:step], np.full(1, pow(base, done, PRIME), U64))
        done += step
    return out[:n]


STRIDE = 1 << 11
BACK = pow(BASE, -1, PRIME)


class SpanHash:
    """64-bit hash of any byte span of a buffer in O(1) after one pass.

    A polynomial in BASE modulo a prime (spans of up to 16 MB).  A power of
    two as the modulus would give equal values to some different texts
    whatever the base.
    """

    # Powers by position in two halves of 30 and 31 bits, kept by the worker; inverse powers by two short tables.
    _low, _high = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    _small, _large = powers(BACK, STRIDE), powers(pow(BACK, STRIDE, PRIME), 1)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls._low) < n:
            n = 1 << n.bit_length()
            p = powers(BASE, n)
            cls._low, cls._high = (p & U64((1 << 30) - 1)).astype(np.uint32), (p >> U64(30)).astype(np.uint32)
            cls._large = powers(pow(BACK, STRIDE, PRIME), n // STRIDE + 1)

    def __init__(self, data: np.ndarray):
        self.grow(len(data))
        value = data.astype(U64) + U64(1)
        self.low, self.high = np.zeros(len(data) + 1, U64), np.zeros(len(data) + 1, U64)
        np.cumsum(value * self._low[:len(data)], out=self.low[1:])
        np.cumsum(value * self._high[:len(data)], out=self.high[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts, ends = np.asarray(starts), np.asarray(ends)
        high = reduced(self.high[ends] - self.high[starts])
        high = ((high & U64((1 << 31) - 1)) << U64(30)) + (high >> U64(31))
        value = reduced(high + reduced(self.low[ends] - self.low[starts]))
        back = product(self._small[starts % STRIDE], self._large[starts // STRIDE])
        return mix(product(value, back))


@dataclass
class Words:
    data: np.ndarray     # bytes of all texts
    offsets: np.ndarray  # byte position of each text, and the end
    starts: np.ndarray   # byte position of each word
    ends: np.ndarray
    first: np.ndarray    # number of the first word of each text, and the count

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return SpanHash(self.data)(self.starts, self.ends)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffer_of(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]            # a text starts a word of its own
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return Words(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, by its first word (whole buffer, text ends ignored)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = hashes[:len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[k:len(hashes) - n + 1 + k]
    return mix(out)


def whole(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which windows of ``n`` words lie in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text[:max(0, total - n + 1)] == text[n - 1:] if total >= n else np.zeros(0, bool)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ``n``-gram hashes of all texts, and the row of each.

    A text of 1 to n-1 words has one shingle of all its words; a text without
    words has none.
    """
    h = words.hashes()
    row = np.repeat(np.arange(len(words.first) - 1), words.counts)
    inside = whole(words.first, n, len(h))
    values, rows = windows(h, n)[inside], row[:len(inside)][inside]
    for k in range(1, n):
        short = np.flatnonzero(words.counts == k)
        at = words.first[short]
        if len(short):
            value = h[at].copy()
            for j in range(1, k):
                value = value * U64(0xD6E8FEB86659FD93) + h[at + j]
            values, rows = np.append(values, mix(value + U64(k))), np.append(rows, short)
    if len(rows) > 1 and (np.diff(rows) < 0).any():
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    return values, rows


def word_strings(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words as one string array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.greater(pc.binary_length(values), 0)
    kept = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)))
    edge = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    return values.filter(keep), np.diff(kept[edge])
