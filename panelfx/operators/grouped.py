"""Sums per group inside Arrow tasks.

Rows reach a task as Arrow batches.  The rows of a group are brought together
by a sort of small integer codes, turned into one matrix, and a function gives
the group's vector of sums.  A task holds at most ``PACKED_CELLS`` numbers,
sends one row per (group, cell), and Spark adds these up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

PACKED_CELLS = 4_000_000  # sums that a task holds before it sends them on
MATRIX_CELLS = 1 << 22    # numbers of a temporary matrix


def groups_of(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Key and row numbers of each group of a batch; a missing key value is None and a group of its own."""
    if not names:
        yield (), np.arange(batch.num_rows)
        return
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
    first = pa.array(order[edges[:-1]])
    keys = zip(*(batch.column(name).take(first).to_pylist() for name in names))
    for key, a, b in zip(keys, edges[:-1], edges[1:]):
        yield key, order[a:b]


def matrix_of(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """The named columns as doubles (missing: NaN), one row per row."""
    out = np.empty((batch.num_rows, len(names)))
    for i, name in enumerate(names):
        out[:, i] = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


Sums = Callable[[tuple, np.ndarray], np.ndarray | None]


def summed(rows: DataFrame, by: Sequence[str], sums: Sums) -> DataFrame:
    """``by`` and an array ``v``: the vectors ``sums(key, matrix)`` of a group added up over all its batches.

    The columns of ``rows`` behind ``by`` are the matrix.  A group may be left
    out (None).  All vectors of a group have one length."""
    packed = summed_cells(rows, by, sums).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return packed.select(*by, F.transform("kv", lambda s: s["v"]).alias("v"))


def collected(rows: DataFrame, by: Sequence[str], sums: Sums) -> dict[tuple, np.ndarray]:
    """The same on the driver, for few groups with small vectors."""
    table = summed_cells(rows, by, sums).toArrow()
    out: dict[tuple, np.ndarray] = {}
    k, v = table.column("k").to_numpy(), table.column("v").to_numpy()
    keys = pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in [*by, "k"]], [*by, "k"])
    for key, at in groups_of(keys, by) if len(k) else ():
        out[key] = np.zeros(len(at))
        out[key][k[at]] = v[at]
    return out


def summed_cells(rows: DataFrame, by: Sequence[str], sums: Sums) -> DataFrame:
    """The same with one row per group and place ``k`` of the vector."""
    by = list(by)
    names = [c for c in rows.columns if c not in by]
    schema = StructType([*rows.select(*by).schema.fields, StructField("k", IntegerType()), StructField("v", DoubleType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        held = 0
        types: list[pa.DataType] = []

        def table() -> pa.RecordBatch:
            keys, vectors = list(total), list(total.values())
            sizes = [len(v) for v in vectors]
            columns = [pa.array([key[i] for key in keys], types[i]).take(pa.array(np.repeat(np.arange(len(keys)), sizes))) for i in range(len(by))]
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            return pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(np.concatenate(vectors))], [*by, "k", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(name).type for name in by]
            data = matrix_of(batch, names)
            for key, at in groups_of(batch, by):
                part = sums(key, data[at])
                if part is None:
                    continue
                if key in total:
                    total[key] = total[key] + part
                else:
                    total[key] = part
                    held += len(part)
            if held > PACKED_CELLS:
                yield table()
                total, held = {}, 0
        if total:
            yield table()

    return rows.mapInArrow(partial, schema).groupBy(*by, "k").agg(F.sum("v").alias("v"))


def group_block(by: Sequence[str], blocks: int) -> Callable[[DataFrame, int], DataFrame]:
    """Filter for one of ``blocks`` parts of the groups."""

    def take(df: DataFrame, block: int) -> DataFrame:
        if blocks == 1 or not by:
            return df
        return df.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == block)

    return take
