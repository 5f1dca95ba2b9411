"""Arrow helpers for tasks that read rows sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a (rows, width) array."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first, last = offsets[column.offset], offsets[column.offset + len(column)]
    return data[first:last].reshape(len(column), width)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


ROWS = 2048


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the groups' starts.

    Groups must be bounded; the last of a batch waits for the next.  A table
    has at most ROWS rows, or one group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        table = table.combine_chunks()
        starts = starts_of(*(table.column(k).to_numpy() for k in keys))
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts[:-1], starts[first] + ROWS, side="right")) - 1)
            yield table.slice(int(starts[first]), int(starts[last] - starts[first])).combine_chunks(), starts[first:last] - starts[first]
            first = last
        held = table.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def chunk(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def pairs_within(starts: np.ndarray, total: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows of the same group, in parts of about ``limit`` pairs."""
    ends = np.repeat(np.append(starts[1:], total), np.diff(np.append(starts, total)))
    later = ends - np.arange(total) - 1
    reach = np.cumsum(later)
    begin = 0
    while begin < total:
        done = reach[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(reach, done + limit, side="right")))
        n = later[begin:stop]
        left = np.repeat(np.arange(begin, stop), n)
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        begin = stop
