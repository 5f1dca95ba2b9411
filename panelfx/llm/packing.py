"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids once, and are cut where their length alone says so:
whole sequences of ``capacity`` ids first, the rest in near-equal pieces of at
most ``piece`` ids.  Whole sequences stand alone.  The other pieces fall into
random groups of bounded size; in each group differencing spreads them over m
windows: every piece starts as a partial partition, and the two partial
partitions with the largest imbalances are merged again and again, fullest
window onto emptiest.  If the fullest window of the result passes the
capacity, m rises by one and the group is packed anew.

Ids are made per distinct word.  The normaliser and the pre-tokenizer of the
vocabulary never join or merge across ASCII white space, so a text's ids are
its words' ids one after another.

Defined results: a null or empty text is the end id alone; equal rows are
packed once each; a null doc_id is packed like any other; an empty table gives
no piece; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.session import stored

from .words import LOWER, SLICE_BYTES, SPACE, buffer_of, slices, word_strings

CAPACITY = 4096
PIECE = 512
END_ID = 2
GROUP_IDS = 1 << 20      # ids of a group on average: bounds a task's memory and its work
KNOWN_BYTES = 96 << 20   # of words and ids kept by a worker between batches; beyond, it starts anew
ENTRY_BYTES = 150        # of a kept word, besides its characters and ids
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[0x61:0x7B] = True
MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True  # without ' < > |


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by a tokenizer file, remembered between batches in two flat arrays."""

    _by_path: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Keep the end mark alone, as word 0."""
        self.place: dict[str, int] = {}
        self.begin, self.flat = np.array([0, 1]), np.array([END_ID], np.uint32)
        self.held = 0

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def places(self, words: list[str]) -> np.ndarray:
        """Number of each word: its ids are flat[begin[number]:begin[number + 1]]."""
        if self.held > KNOWN_BYTES:
            self.forget()
        new = [w for w in words if w not in self.place]
        for start in range(0, len(new), 20_000):
            part = new[start:start + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.place.update(zip(part, range(len(self.begin) - 1, len(self.begin) - 1 + len(part))))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum([len(x) for x in ids])))
            self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.uint32)))
            self.held += sum(ENTRY_BYTES + 4 * len(w) + 4 * len(x) for w, x in zip(part, ids))
        return np.fromiter((self.place[w] for w in words), np.int64, len(words))


def split_plain(texts: pa.Array) -> pa.Array:
    """Texts with ASCII capitals lowered and a space between an ASCII letter and the ASCII mark behind it.

    Neither changes the ids: the normaliser lowers anyway, and a letter and a
    mark are always in different pre-tokens (marks of contractions and of
    special tokens are left alone).  Both make for fewer distinct words.  The
    normaliser composes before it lowers, so words with other than ASCII bytes
    stay as they are; so do words with '<|', where the case of a special token
    counts.
    """
    data, offsets = buffer_of(texts)
    if not len(data):
        return texts
    space = SPACE[data]
    begins = space.copy()
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    word = np.cumsum(begins)
    odd = data >= 0x80
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    left_alone = np.zeros(int(word[-1]) + 1, bool)
    left_alone[word[odd]] = True
    plain = ~left_alone[word]
    data = np.where(plain, LOWER[data], data)
    at = np.flatnonzero(LETTER[data[:-1]] & MARK[data[1:]] & plain[:-1] & plain[1:]) + 1
    data, offsets = np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def text_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each closed by END_ID, and where each text starts (one more at the end)."""
    words, counts = word_strings(split_plain(texts))
    coded = words.dictionary_encode()
    known = WordIds.of(path)
    place = known.places(coded.dictionary.to_pylist())
    number = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    number = np.insert(number, ends, 0)  # the end mark behind each text
    size = np.diff(known.begin)[number]
    upto = np.cumsum(size)
    source = np.arange(upto[-1] if len(upto) else 0) + np.repeat(known.begin[number] - (upto - size), size)
    return known.flat[source], np.concatenate(([0], upto[ends + np.arange(len(ends))]))


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Where a document of ``n`` ids is cut: whole sequences, then near-equal pieces."""
    full = n - n % capacity
    rest = n - full
    parts = -(-rest // piece)
    return [*range(0, full, capacity), *(full + rest * k // parts for k in range(parts)), n]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and a number of its own (``place``)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ["start", "length", "ids_crc32", "doc_tokens", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                ids, edges = text_ids(part.column("text"), path)
                ids = ids.astype("<u4")
                rows, row_of = [], []
                for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    marks = cuts(b - a, capacity, piece)
                    for s, e in zip(marks[:-1], marks[1:]):
                        rows.append((s, e - s, zlib.crc32(ids[a + s:a + e]), b - a, place))
                        row_of.append(k)
                        place += 1
                columns = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row_of, pa.int64())), *(pa.array(c) for c in columns.T.copy())], ["doc_id", *fields])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{f} long" for f in fields))


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over ``windows`` windows: the window of each size, and the windows' sums.

    A partial partition is a sorted vector of window sums less their minimum,
    with the windows' members as linked lists.  Merging puts the fullest
    window of one onto the emptiest of the other.
    """
    if windows == 1:
        return np.zeros(len(sizes), np.int64), np.array([sizes.sum()])
    parent = list(range(len(sizes)))  # union of the pieces of one window, by their first piece

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    heap = []
    for k, size in enumerate(sizes.tolist()):
        sums, first = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], first[-1] = size, k
        heap.append((-size, k, sums, first))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, sums, first = heapq.heappop(heap)
        _, _, sums_b, first_b = heapq.heappop(heap)
        total = sums + sums_b[::-1]
        other = first_b[::-1]
        joined = np.where(first < 0, other, first)
        for w in np.flatnonzero((first >= 0) & (other >= 0)).tolist():
            parent[top(int(other[w]))] = top(int(first[w]))
        order = np.argsort(total, kind="stable")
        total, joined = total[order], joined[order]
        total -= total[0]
        heapq.heappush(heap, (-int(total[-1]), number, total, joined))
        number += 1
    roots = np.array([top(k) for k in range(len(sizes))], np.int64)
    _, window = np.unique(roots, return_inverse=True)
    return window, np.bincount(window, weights=sizes, minlength=windows).astype(np.int64)


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; windows rise from the least possible number until none passes the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, windows)
        if sums.max(initial=0) <= capacity:
            return window
        windows += 1


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE,
         group_ids: int = GROUP_IDS) -> DataFrame:
    """Pieces of all documents with sequence and offset."""
    cut = stored(pieces(documents, path or default_vocabulary(), capacity, piece), "pack-pieces")
    total = cut.where(F.col("length") < capacity).agg(F.sum("length").alias("ids")).first()["ids"] or 0
    groups = max(1, -(-total // group_ids))
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        sizes = group.column("length").to_numpy()
        window = pack_group(sizes, capacity)
        order = np.lexsort((np.arange(len(sizes)), window))
        before = np.cumsum(sizes[order]) - sizes[order]
        starts = np.concatenate(([True], np.diff(window[order]) != 0))
        offset = before - np.repeat(before[starts], np.diff(np.append(np.flatnonzero(starts), len(order))))
        group = group.take(pa.array(order))
        number = (group.column("grp").to_numpy() << 32 | window[order]) * 2
        return pa.Table.from_arrays([*(group.column(n) for n in names[:5]), pa.array(number, pa.int64()), pa.array(offset.astype(np.int64))], names=names)

    grouped = cut.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(groups)))
    packed = grouped.groupBy("grp").applyInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    return full.unionByName(packed)
