"""Token counts by a two-tier lookup inside the map tasks.

A text's tokens are those of its pre-tokens one after another, so a count only
needs the length of each pre-token.  First tier: a compact hash table of the
lengths of frequent pre-tokens, sent to every worker once.  Second tier: what
the table misses is encoded by the tokenizer and remembered in a cache of the
worker, bounded by bytes.  No pre-token is shuffled.

What is frequent is counted over all texts: every task keeps a Misra-Gries
summary of its pre-tokens and reports at most ``PER_TASK`` of them; these
reports alone are added up.  The table holds at most ``ENTRIES`` pre-tokens of
at most ``MAX_BYTES`` bytes, so its size has a bound.  It decides about speed
only: a count is the tokenizer's whatever the table holds.

A pre-token here is a word between ASCII white space.  A word of printable
ASCII is lowered and cut further where letters, digits and marks meet, as the
vocabulary's own pre-tokenizer does.  Words with other bytes (composed before
they are lowered), with ``'`` (contractions) or with ``<|`` (special tokens)
are looked up whole.  Long texts are cut at white space into blocks, so a task
holds arrays for one block at a time; only a single word can make a block
longer.

Defined results: a null or empty text has 0 bytes and 0 tokens; equal rows are
counted once each; a null key is carried along; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import default_vocabulary
from .words import LOWER, SPACE, SpanHash, buffer_of

LIMIT = 2048
BLOCK_BYTES = 1 << 20
ENTRIES = 1 << 15
MAX_BYTES = 32
PER_TASK = 1 << 12
CACHE_BYTES = 32 << 20   # of a worker's cache; beyond, it starts anew
CACHED_WORD = 1 << 10    # longer words are encoded each time
ENCODE_BYTES = 1 << 20   # given to the tokenizer at once

LETTERS, DIGITS, MARKS = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = MARKS
KIND[0x30:0x3A] = DIGITS
KIND[0x61:0x7B] = LETTERS
KIND[0x27] = 0           # the contraction mark leaves a word whole


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that end where a text ends or at white space."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + limit, end)
        if stop < end:
            text_end = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            if text_end > start:
                stop = text_end
            else:
                spaces = np.flatnonzero(SPACE[data[start:stop]])
                if len(spaces) and spaces[-1]:
                    stop = start + int(spaces[-1])
                else:  # one word fills the block: up to its end
                    stop = int(offsets[np.searchsorted(offsets, start, side="right")])
                    for at in range(start + 1, stop, limit):
                        spaces = np.flatnonzero(SPACE[data[at:min(at + limit, stop)]])
                        if len(spaces):
                            stop = at + int(spaces[0])
                            break
        yield start, stop
        start = stop


def pre_tokens(data: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of bytes ``start`` to ``stop``, and the row of each."""
    inside = ~SPACE[data[start:stop]]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, stop)] - start
    opens[begins] = inside[begins]
    at = np.flatnonzero(inside)
    body, cut = data[start:stop][at], opens[at]
    if not len(body):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    lowered = LOWER[body]
    kind = KIND[lowered]
    odd = kind == 0
    odd[:-1] |= (body[:-1] == 0x3C) & (body[1:] == 0x7C)
    word = np.cumsum(cut) - 1
    whole = np.zeros(int(word[-1]) + 1, bool)
    whole[word[odd]] = True
    plain = ~whole[word]
    body = np.where(plain, lowered, body)
    cut[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGITS))
    starts = np.flatnonzero(cut)
    places = np.append(starts, len(body)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(body.tobytes())])
    return units, np.searchsorted(offsets, at[starts] + start, side="right") - 1


class LengthTable:
    """Open-addressing hash table from byte strings to token counts; equal means equal bytes."""

    def __init__(self, units: list[bytes], lengths: list[int]):
        self.begin = np.concatenate(([0], np.cumsum([len(u) for u in units]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(units), np.uint8)
        self.lengths = np.array(lengths, np.int32)
        self.mask = (1 << max(1, 2 * len(units)).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        home = self.home(self.blob, self.begin[:-1], self.begin[1:])
        for k, slot in enumerate(home.tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slots[slot] = k

    def home(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (SpanHash(data)(starts, ends) & np.uint64(self.mask)).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.begin, self.blob, self.lengths, self.slots))

    def find(self, units: pa.Array) -> np.ndarray:
        """Token count of each unit, -1 where the table has none."""
        data, offsets = buffer_of(units)
        starts, ends = offsets[:-1], offsets[1:]
        out = np.full(len(units), -1, np.int64)
        left = np.flatnonzero(ends - starts <= MAX_BYTES)
        slot = self.home(data, starts, ends)
        while len(left):
            entry = self.slots[slot[left]]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = ends[left] - starts[left] == self.begin[entry + 1] - self.begin[entry]
            pick, of = left[same], entry[same]
            size = ends[pick] - starts[pick]
            upto = np.cumsum(size)
            step = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size)
            differs = data[np.repeat(starts[pick], size) + step] != self.blob[np.repeat(self.begin[of], size) + step]
            wrong = np.zeros(len(pick), bool)
            wrong[np.repeat(np.arange(len(pick)), size)[differs]] = True
            out[pick[~wrong]] = self.lengths[of[~wrong]]
            left = left[out[left] < 0]
            slot[left] = (slot[left] + 1) & self.mask
        return out


class Lengths:
    """Token counts by the tokenizer, remembered by the worker between tasks."""

    _by_path: dict[str, Lengths] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> Lengths:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def encode(self, units: list[str]) -> Iterator[int]:
        start = size = 0
        for k, unit in enumerate(units):
            size += len(unit)
            if size > ENCODE_BYTES or k + 1 == len(units):
                for e in self.tokenizer.encode_batch_fast(units[start:k + 1], add_special_tokens=False):
                    yield len(e.ids)
                start, size = k + 1, 0

    def __call__(self, units: list[str]) -> np.ndarray:
        new = [u for u in units if u not in self.known]
        found = dict(zip(new, self.encode(new)))
        out = np.fromiter((found[u] if u in found else self.known[u] for u in units), np.int64, len(units))
        keep = {u: n for u, n in found.items() if len(u) <= CACHED_WORD}
        grown = sum(len(u) + 150 for u in keep)  # text and entry
        if self.held + grown > CACHE_BYTES:
            self.known, self.held = {}, 0
        if grown <= CACHE_BYTES:
            self.known.update(keep)
            self.held += grown
        return out


def summary(units: pa.Array, counts: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray]:
    """Misra-Gries: the ``most`` largest counts, each less the next one below them."""
    if len(units) <= most:
        return units, counts
    floor = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    keep = np.flatnonzero(counts > floor)
    return units.take(pa.array(keep)), counts[keep] - floor


def frequent(documents: DataFrame, text: str, entries: int) -> list[bytes]:
    """The commonest pre-tokens of all texts, by the tasks' summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(0))
            for start, stop in blocks(data, offsets):
                found = pre_tokens(data, offsets, start, stop)[0]
                seen = found.filter(pc.less_equal(pc.binary_length(found), MAX_BYTES)).value_counts()
                both = pa.table({"unit": pa.chunked_array([units, seen.field(0)]), "n": pa.chunked_array([pa.array(counts), seen.field(1)])})
                both = both.group_by("unit").aggregate([("n", "sum")]).combine_chunks()
                units, counts = summary(both.column("unit").combine_chunks(), both.column("n_sum").to_numpy(), PER_TASK)
        if len(units):
            yield pa.RecordBatch.from_arrays([units.cast(pa.string()), pa.array(counts)], ["unit", "n"])

    reports = documents.select(F.col(text).alias("text")).mapInArrow(run, "unit string, n long")
    top = reports.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(entries)
    return [r.unit.encode() for r in top.collect()]


def token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text",
                 entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    path = path or default_vocabulary()
    common = frequent(documents, text, entries)
    table = LengthTable(common, Lengths.of(path)([u.decode() for u in common]).tolist())
    sent = documents.sparkSession.sparkContext.broadcast(table)  # at most ENTRIES units of MAX_BYTES bytes
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths.of(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            total = np.zeros(batch.num_rows, np.int64)
            for start, stop in blocks(data, offsets):
                units, row = pre_tokens(data, offsets, start, stop)
                coded = units.dictionary_encode()
                found = sent.value.find(coded.dictionary)
                missed = np.flatnonzero(found < 0)
                found[missed] = lengths(coded.dictionary.take(pa.array(missed)).to_pylist())
                if len(row):
                    first = int(row[0])
                    sums = np.bincount(row - first, weights=found[coded.indices.to_numpy(zero_copy_only=False)])
                    total[first:first + len(sums)] += sums.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
