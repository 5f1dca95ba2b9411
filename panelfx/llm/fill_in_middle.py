"""Fill-in-the-middle transformation with a learned rank index.

A text is cut at two of its token boundaries into prefix, middle and suffix,
which are put out in another order between marks.  The cuts are drawn as ranks
(numbers of tokens), so every text needs the byte offset of a boundary by its
rank.  The index is a piecewise-linear function per text: its boundaries are
split in halves until a line through a segment's ends, moved to the middle of
its errors, is off by at most ``ERROR`` bytes at each of them.  A segment keeps
start, offset and slope, every boundary one byte: the error that is left.  A
cut is predicted from its segment and corrected exactly by that byte.

A text is scanned in blocks, so besides the text a task holds one byte per
token and the segments.

Defined results: a null text counts as empty; a text without tokens or with
one of the marks stays as it is (form ``plain``); draws of a null key take the
word ``null`` in its place, and equal keys draw alike; an empty table gives an
empty table; columns besides key and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .words import SPACE, buffer_of

MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 42
RATE = 50           # percent of the texts that are transformed
SPM_RATE = 80       # percent of those that put the suffix first
ERROR = 127         # a residual is one signed byte
SEGMENT = 1 << 12   # boundaries of a segment at most
BLOCK_BYTES = 1 << 20


def boundaries(text: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Byte offsets where tokens end, in runs: a token is a word with the white space before it, or the white space at the end."""
    for start in range(0, len(text), block):
        space = SPACE[text[start:start + block + 1]]  # one byte ahead
        here = min(block, len(text) - start)
        ends = ~space[:here]
        ends[:len(space) - 1] &= space[1:here + 1]
        if start + here == len(text):
            ends[-1] = True
        found = np.flatnonzero(ends) + start + 1
        if len(found):
            yield found


def straight(x: np.ndarray, error: int, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of ``x`` by halving: starts, offsets, slopes, and what each value is off."""
    todo = np.arange(0, len(x), most)
    ends = np.minimum(todo + most, len(x))
    rest = np.zeros(len(x), np.int8)
    done: list[tuple[np.ndarray, ...]] = []
    while len(todo):
        size = ends - todo
        slope = (x[ends - 1] - x[todo]) / np.maximum(size - 1, 1)
        upto = np.cumsum(size)
        step = np.arange(upto[-1]) - np.repeat(upto - size, size)
        at = np.repeat(todo, size) + step
        off = x[at] - np.repeat(x[todo], size) - np.floor(np.repeat(slope, size) * step).astype(np.int64)
        heads = upto - size
        low, high = np.minimum.reduceat(off, heads), np.maximum.reduceat(off, heads)
        middle = (low + high) // 2
        good = np.maximum(high - middle, middle - low) <= error
        inside = np.repeat(good, size)
        rest[at[inside]] = (off - np.repeat(middle, size))[inside]
        done.append((todo[good], x[todo[good]] + middle[good], slope[good]))
        half = todo[~good] + size[~good] // 2
        todo, ends = np.concatenate((todo[~good], half)), np.concatenate((half, ends[~good]))
        order = np.argsort(todo)
        todo, ends = todo[order], ends[order]
    starts, offsets, slopes = (np.concatenate(c) for c in zip(*done))
    order = np.argsort(starts)
    return starts[order], offsets[order], slopes[order], rest


class RankIndex:
    """Byte offset of a text's token boundary by its rank (0: the text's start)."""

    def __init__(self, text: np.ndarray, error: int = ERROR, block: int = BLOCK_BYTES):
        parts = []
        self.size = 0
        for found in boundaries(text, block):
            starts, offsets, slopes, rest = straight(found, error)
            parts.append((starts + self.size, offsets, slopes, rest))
            self.size += len(found)
        if parts:
            self.starts, self.offsets, self.slopes, self.rest = (np.concatenate(c) for c in zip(*parts))

    def predict(self, rank: int) -> int:
        k = int(np.searchsorted(self.starts, rank - 1, side="right")) - 1
        return int(self.offsets[k]) + int(np.floor(self.slopes[k] * (rank - 1 - self.starts[k])))

    def __getitem__(self, rank: int) -> int:
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        return self.predict(rank) + int(self.rest[rank - 1]) if rank else 0


def characters(text: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return len(text) - int(np.count_nonzero((text & 0xC0) == 0x80))


def draws(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transformed(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
                spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every text."""
    kind = documents.schema[key].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def transform(raw: bytes, name: str) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        index = RankIndex(data)
        h = draws(name, seed)
        if not raw or any(mark in raw for mark in MARKS) or h[2] % 100 >= rate:
            return index.size, "plain", None, None, raw
        low, high = sorted((h[0] % (index.size + 1), h[1] % (index.size + 1)))
        a, b = index[low], index[high]
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        p, s, m = MARKS
        spm = h[3] % 100 < spm_rate
        output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
        return index.size, "spm" if spm else "psm", characters(data[:a]), characters(data[a:b]), output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            keys = batch.column("name").to_pylist()
            rows, held, start = [], 0, 0
            for k in range(batch.num_rows):
                rows.append(transform(data[offsets[k]:offsets[k + 1]].tobytes(), keys[k]))
                held += len(rows[-1][-1])
                if held > 8 << 20 or k + 1 == batch.num_rows:
                    n, form, prefix, middle, output = zip(*rows)
                    columns = [n, form, prefix, middle, pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(start, len(rows)), *(pa.array(c, t) if isinstance(c, tuple) else c for c, t in zip(columns, types))], names)
                    rows, held, start = [], 0, k + 1

    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return documents.select(F.col(key).alias("doc_id"), name.alias("name"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: the parts between its marks, which no part holds."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
