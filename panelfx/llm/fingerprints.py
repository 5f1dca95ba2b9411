"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; it depends on the last 32 bytes only,
so boundaries move with the text when something is inserted before them.
Chunking is normalised: up to the normal length a boundary must meet a strict
mask, beyond it a loose one, and the longest length ends a chunk anyway.  A
fingerprint is the list of distinct chunk digests with their lengths; likeness
is the shared length over the longer side's length, containment over one's
own.

Defined results: a null text is empty; an empty text has the empty
fingerprint, which is like another empty one (1) and unlike all others (0);
rows are ordered by doc_id (null first), then by text; the last row's next is
the first, and a single row's next is itself; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfx.session import stored

from .words import mix

WIDTH = 32                       # bytes that the gear hash sees
LEAST, NORMAL, MOST = 64, 256, 2048
STRICT, LOOSE = 0xFF800000 << 1 & 0xFFFFFFFF, 0xFE000000  # 8 and 7 top bits about NORMAL
GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Hash at every byte: sum of GEAR of the last 32 bytes, each shifted by its age."""
    h = GEAR[data]
    span = 1
    while span < WIDTH:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span) if len(h) > span else 0
        h = h + older
        span *= 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    loose = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
    strict = loose[(h[loose] & np.uint32(STRICT)) == 0].tolist()
    loose = loose.tolist()
    ends, start = [], 0
    while n - start > LEAST:
        end = min(n, start + MOST)
        k = bisect_left(strict, start + LEAST)
        if k < len(strict) and strict[k] < min(start + NORMAL, end):
            end = strict[k] + 1
        else:
            k = bisect_left(loose, start + NORMAL)
            if k < len(loose) and loose[k] < end:
                end = loose[k] + 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


Chunks = dict[bytes, int]


def chunk_set(raw: bytes) -> Chunks:
    """Digest of every distinct chunk and its length."""
    out, start = {}, 0
    for end in chunk_ends(np.frombuffer(raw, np.uint8)):
        chunk = raw[start:end]
        out[hashlib.blake2b(chunk, digest_size=8).digest()] = len(chunk)
        start = end
    return out


def as_text(chunks: Chunks) -> str:
    return ",".join(f"{d.hex()}:{n}" for d, n in sorted(chunks.items()))


def likeness(a: Chunks, b: Chunks) -> float:
    if not a and not b:
        return 1.0
    shared = sum(n for d, n in a.items() if d in b)
    return shared / max(sum(a.values()), sum(b.values()))


def containment(a: Chunks, b: Chunks) -> float:
    """Share of ``a``'s length whose chunks are in ``b`` too."""
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the start of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RANGE_CHARS = 64  # of a text, which tell rows with one doc_id apart when rows are dealt to tasks
FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, kept_share double")


class Row:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.chunks = chunk_set(self.text.encode())

    def beside(self, following: Row) -> tuple:
        other = edited(self.text, following.text)
        raw = other.encode()
        chunks = chunk_set(raw)
        return (self.doc_id, len(self.text), hashlib.sha256(raw).hexdigest(), as_text(self.chunks), as_text(chunks),
                likeness(self.chunks, chunks), likeness(self.chunks, following.chunks), containment(self.chunks, chunks))


def fingerprint(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and its likeness to the next document.

    Rows are dealt out by ranges of doc_id, so that a row's next is mostly the
    next row of its task.  The first and the last row of each task are put
    aside with their texts and paired in a second, small step.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple], edges: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        """Finished rows, then rows that carry a text for the second step: (part, is_last, doc_id, text)."""
        n, m = len(rows), len(edges)
        columns = list(zip(*rows)) if n else [()] * len(names)
        arrays = [pa.array([*columns[0], *(e[2] for e in edges)], doc_type)]
        arrays += [pa.array([*c, *[None] * m], t) for c, t in zip(columns[1:], types[1:])]
        arrays += [pa.array([*[None] * n, *(e[0] for e in edges)], pa.int64()),
                   pa.array([*[None] * n, *(e[1] for e in edges)], pa.bool_()),
                   pa.array([*[None] * n, *(e[3] for e in edges)], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "part", "is_last", "edge_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, doc_type = TaskContext.get().partitionId(), None, None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            rows, edges, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                row = Row(doc_id, text.as_py())
                if last is None:
                    edges.append((part, False, row.doc_id, row.text))
                else:
                    rows.append(last.beside(row))
                    held += len(rows[-1][3]) * 2
                last = row
                if held > 4 << 20:
                    yield batch_of(rows, edges, doc_type)
                    rows, edges, held = [], [], 0
            if rows or edges:
                yield batch_of(rows, edges, doc_type)
        if last is not None:
            yield batch_of([], [(part, True, last.doc_id, last.text)], doc_type)

    # Rows that share a doc_id are dealt by how their texts begin, in the order in which tasks sort them.
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    schema = f"doc_id {id_type}, {FIELDS}, part long, is_last boolean, edge_text string"
    table = stored(ordered.mapInArrow(run, schema), "fingerprints")
    done = table.where("part is null").select(*names)
    # Two rows per task: the tail of a task meets the head of the next task that has rows (the last one, the first).
    edges = table.where("part is not null").select("doc_id", "part", "is_last", "edge_text")
    heads = edges.where("not is_last").select(F.col("part").alias("head_part"), F.col("doc_id").alias("head_id"), F.col("edge_text").alias("head_text"))
    # The window sees a number per task, never a text.
    by_part = Window.orderBy("head_part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = heads.select("head_part").select("head_part", F.coalesce(F.lag("head_part").over(by_part), F.max("head_part").over(everything)).alias("part"))
    pairs = (edges.where("is_last").join(before, "part").join(heads, "head_part")
             .select("doc_id", "edge_text", "head_id", "head_text"))

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, head_id, head_text in zip(*(c.to_pylist() for c in batch.columns)):
                row = Row(doc_id, text).beside(Row(head_id, head_text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t or batch.schema.field("doc_id").type) for v, t in zip(row, types)], names)

    return done.unionByName(pairs.mapInArrow(join_edges, f"doc_id {id_type}, {FIELDS}"))
