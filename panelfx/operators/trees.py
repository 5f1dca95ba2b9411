"""Boosted trees and forests for many models at once (#74, #82, #84, #86).

Covariates are cut once into at most ``BINS`` ranges (edges from a sketch of
all rows; missing counts as lowest).  Rows of a group with the same ranges and
the same training marks are one *cell* with a count and sums of the targets:
boosting by squared or logistic loss needs no more, because all rows of a cell
have the same prediction.  Cells come from one map-side combined aggregation.

All models (a target and a training mark each: folds, arms) of all groups grow
together, level by level: per (model, node, covariate, range) the cells' counts
and gradient sums are added up, the best cut of each node is taken, and the
next level starts.  Where no group has more than ``TASK_CELLS`` cells, a
group's levels run inside one task, one job for all groups and models.  Beyond
that each level is a pass over the cells, so the jobs are those of trees x
depth, whatever the number of models.

A forest draws Poisson(1) weights per row; a cell of n rows has a Poisson(n)
weight, drawn from a hash of the cell, the tree and a seed.  Trees are sent to
the workers for prediction; groups are handled in blocks of at most
``SENT_NODES`` nodes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..session import drop_stored, stored
from .grouped import group_block, groups_of

BINS = 64
TASK_CELLS = 200_000
SENT_NODES = 8_000_000
REWRITE = 8        # trees after which a pass over the cells stores the predictions


@dataclass(frozen=True)
class Shape:
    """What is grown.  The reference's settings are given where they are used."""
    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    min_leaf: int = 1
    loss: str = "squared"       # "squared", "logistic" (boosted) or "mean" (forest)
    share: float = 1.0          # of the covariates tried at a node (forest)
    seed: int = 42


class Ensemble:
    """The trees of one group: covariate, range and value per (model, tree, node), nodes as in a heap."""

    def __init__(self, models: int, shape: Shape, start: np.ndarray):
        nodes = (2 << shape.depth) - 1
        self.shape, self.start = shape, start
        self.cut = np.full((models, shape.trees, nodes), -1, np.int16)   # covariate; -1: a leaf
        self.bin = np.zeros((models, shape.trees, nodes), np.int16)
        self.value = np.zeros((models, shape.trees, nodes))

    def node(self, model: int, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches within ``depth`` levels."""
        at = np.zeros(len(bins), np.int64)
        cut, limit = self.cut[model, tree], self.bin[model, tree]
        for _ in range(depth):
            c = cut[at]
            right = bins[np.arange(len(bins)), np.maximum(c, 0)] > limit[at]
            at = np.where(c < 0, at, 2 * at + 1 + right)
        return at

    def score(self, model: int, bins: np.ndarray, trees: range) -> np.ndarray:
        """Sum of the trees' values."""
        out = np.zeros(len(bins))
        for tree in trees:
            out += self.value[model, tree][self.node(model, tree, bins, self.shape.depth)]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Prediction of every model, one column each."""
        models, trees = self.cut.shape[:2]
        out = np.empty((len(bins), models))
        for m in range(models):
            total = self.score(m, bins, range(trees))
            if self.shape.loss == "mean":
                out[:, m] = total / trees
            else:
                total = self.start[m] + self.shape.rate * total
                out[:, m] = 1 / (1 + np.exp(-np.clip(total, -700, 700))) if self.shape.loss == "logistic" else total
        return out


@dataclass
class Cells:
    """Cells of one group: ranges, count, target sums per model, training marks per model, hash, prediction so far per model."""
    bins: np.ndarray
    count: np.ndarray
    target: np.ndarray     # cells x models: sums over the cell's rows
    train: np.ndarray      # cells x models: 0 or 1
    hash: np.ndarray
    score: np.ndarray


def poisson(mean: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Poisson draws by inverse distribution, from 64 hash bits each; large means by their normal limit."""
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    out = np.zeros(len(mean))
    large = mean > 50
    if large.any():
        spread = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * ((bits[large] & np.uint64(0x7FF)).astype(np.float64) + 0.5) / 2048)
        out[large] = np.maximum(0, np.rint(mean[large] + np.sqrt(mean[large]) * spread))
    small = ~large
    p = np.exp(-mean[small])
    total, k, drawn = p.copy(), 0, np.zeros(small.sum())
    while k < 200 and (u[small] >= total).any():
        k += 1
        p = p * mean[small] / k
        drawn += u[small] >= total
        total += p
    out[small] = drawn
    return out


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def histogram(cells: Cells, grown: Ensemble, tree: int, level: int, done: int) -> np.ndarray:
    """Count, gradient and curvature sums per (model, node of the level, covariate, range); ``score`` holds ``done`` trees."""
    shape, models = grown.shape, cells.train.shape[1]
    nodes, p = 1 << level, cells.bins.shape[1]
    out = np.zeros((models, nodes, p, BINS, 3))
    for m in range(models):
        on = np.flatnonzero(cells.train[:, m])
        at = grown.node(m, tree, cells.bins[on], level) - (nodes - 1)
        on, at = on[at >= 0], at[at >= 0]  # those below an early leaf are done
        if not len(on):
            continue
        count, target = cells.count[on], cells.target[on, m]
        if shape.loss == "mean":
            weight = poisson(count, mixed(cells.hash[on], shape.seed * 1000 + tree)) / count
            parts = (count * weight, target * weight, count * weight)
        else:
            score = cells.score[on, m] + shape.rate * grown.score(m, cells.bins[on], range(done, tree))
            if shape.loss == "logistic":
                chance = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                parts = (count, target - count * chance, count * chance * (1 - chance))
            else:
                parts = (count, target - count * score, count)
        for f in range(p):
            place = at * BINS + cells.bins[on, f]
            for k, part in enumerate(parts):
                out[m, :, f, :, k] = np.bincount(place, weights=part, minlength=nodes * BINS).reshape(nodes, BINS)
    return out


def grow(grown: Ensemble, tree: int, level: int, sums: np.ndarray) -> None:
    """Set cuts and values of a level from its histogram, and the values of the level below."""
    shape = grown.shape
    models, nodes, p = sums.shape[:3]
    for m in range(models):
        total = sums[m, :, 0].sum(axis=1)                       # nodes x 3
        left = np.cumsum(sums[m], axis=2)                        # nodes x p x ranges x 3
        right = total[:, None, None] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (total[:, 1] ** 2 / total[:, 0])[:, None, None]
        least = max(shape.min_leaf, 1e-9)
        gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least), gain, -np.inf)
        if shape.share < 1:
            tried = max(1, int(round(shape.share * p)))
            name = (np.uint64(m) << np.uint64(40)) + (np.arange(nodes, dtype=np.uint64)[:, None] << np.uint64(20)) + np.arange(p, dtype=np.uint64)
            rank = np.argsort(np.argsort(mixed(name, shape.seed * 7919 + tree * 64 + level), axis=1), axis=1)
            gain = np.where((rank < tried)[:, :, None], gain, -np.inf)
        flat = gain.reshape(nodes, -1)
        best = np.argmax(flat, axis=1)
        worth = flat[np.arange(nodes), best] > 1e-12 * np.maximum(1, np.abs(total[:, 1]))
        f, b = best // BINS, best % BINS
        first = nodes - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(total[:, 0] > 0, total[:, 1] / np.where(np.abs(total[:, 2]) < 1e-150, 1, total[:, 2]), 0.0)
        if level == 0:
            grown.value[m, tree, 0] = own[0]
        for node in np.flatnonzero(worth):
            at = first + node
            grown.cut[m, tree, at], grown.bin[m, tree, at] = f[node], b[node]
            for side, part in ((1, left), (2, right)):
                s = part[node, f[node], b[node]]
                grown.value[m, tree, 2 * at + side] = s[1] / s[2] if abs(s[2]) >= 1e-150 else 0.0


def starts(shape: Shape, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What the boosting of each model starts from."""
    mean = np.where(weight > 0, target / np.maximum(weight, 1e-300), 0.0)
    if shape.loss == "logistic":
        mean = np.clip(mean, 1e-12, 1 - 1e-12)
        return np.where(weight > 0, np.log(mean / (1 - mean)), 0.0)
    return np.where(shape.loss == "squared", mean, 0.0)


def grown_in_task(cells: Cells, shape: Shape) -> Ensemble:
    """All trees of one group."""
    weight = (cells.train * cells.count[:, None]).sum(axis=0)
    out = Ensemble(cells.train.shape[1], shape, starts(shape, weight, (cells.train * cells.target).sum(axis=0)))
    cells.score = np.tile(out.start, (len(cells.bins), 1))
    for tree in range(shape.trees):
        for level in range(shape.depth):
            grow(out, tree, level, histogram(cells, out, tree, level, tree))
        if shape.loss != "mean":
            for m in range(cells.train.shape[1]):
                cells.score[:, m] += shape.rate * out.score(m, cells.bins, range(tree, tree + 1))
    return out


class Trees:
    """Fitted trees: ``predict`` adds one column per model."""

    def __init__(self, by: list[str], xs: list[str], names: list[str], edges: list[np.ndarray], parts: list[dict[tuple, Ensemble]]):
        self.by, self.xs, self.names, self.edges, self.parts = by, xs, names, edges, parts

    def predict(self, df: DataFrame, out: Sequence[str] | None = None) -> DataFrame:
        """``df`` with the prediction of every model; missing where the group has no trees."""
        out = list(out or self.names)
        cut = [f"_key{i}" for i in range(len(self.by))]
        take = group_block(cut, len(self.parts))  # by the values' text, as the cells were cut
        named = df.withColumns({c: key_text(name) for c, name in zip(cut, self.by)})
        pieces = [self._block(take(named, k), part, out) for k, part in enumerate(self.parts)]
        whole = pieces[0]
        for piece in pieces[1:]:
            whole = whole.unionByName(piece)
        return whole.drop(*cut)

    def _block(self, df: DataFrame, part: dict[tuple, Ensemble], out: list[str]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(part)  # at most SENT_NODES nodes, see fit_trees
        edges, width, by = self.edges, len(self.names), self.by

        @F.pandas_udf("array<double>")
        def run(rows: pd.DataFrame) -> pd.Series:
            keys = [f"k{i}" for i in range(len(by))]
            batch = pa.RecordBatch.from_arrays([pa.array(rows[k], pa.string(), from_pandas=True) for k in keys] + [pa.array(np.arange(len(rows)))], [*keys, "row"])
            found = np.full((len(rows), width), np.nan)
            bins = ranges(rows[[f"x{i}" for i in range(len(edges))]].to_numpy(dtype=float), edges)
            for key, at in groups_of(batch, keys):
                ensemble = sent.value.get(key)
                if ensemble is not None:
                    found[at] = ensemble.predict(bins[at])
            return pd.Series(list(found))

        fields = [key_text(c).alias(f"k{i}") for i, c in enumerate(by)] + [F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(self.xs)]
        held = "_trees"
        scored = df.withColumn(held, run(F.struct(*fields)))
        return scored.withColumns({name: F.nanvl(F.get(F.col(held), F.lit(i)), F.lit(None).cast("double")) for i, name in enumerate(out)}).drop(held)


def key_text(c: str) -> Column:
    """A group value as text, so that it is the same wherever it is read; missing stays missing."""
    return F.col(c).cast("string")


def ranges(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Range of every value: one more than the number of edges below it, 0 for missing."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i], side="left"))
    return out


def range_edges(df: DataFrame, xs: Sequence[str]) -> list[np.ndarray]:
    """At most BINS - 2 edges per covariate: all distinct values but the largest if there are few, else quantiles of a sketch."""
    probs = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = df.agg(*[F.percentile_approx(F.col(x).cast("double"), [*probs, 1.0], 10_000).alias(f"_e{i}") for i, x in enumerate(xs)]).first()
    out = []
    for i in range(len(xs)):
        values = np.unique([v for v in row[i] or [] if not np.isnan(v)])
        out.append(values[:-1])  # the largest value is no edge: nothing lies above it
    return out


def fit_trees(df: DataFrame, xs: Sequence[str], models: dict[str, tuple[Column, Column]], by: Sequence[str] = (), shape: Shape = Shape(),
              task_cells: int = TASK_CELLS) -> Trees:
    """Trees for every model (target and training rows) in every group of ``by``; a group without training rows predicts 0."""
    spark, by, xs, names = df.sparkSession, list(by), list(xs), list(models)
    edges = range_edges(df, xs)
    keys = [f"k{i}" for i in range(len(by))]
    nodes = len(models) * shape.trees * ((2 << shape.depth) - 1)
    table = _cells(df, by, keys, xs, edges, models)
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n")).first()
    blocks = max(1, -(-known["groups"] * nodes // SENT_NODES))
    take = group_block(keys, blocks)
    fit = _in_tasks if (known["n"] or 0) <= task_cells else _in_passes
    parts = [fit(take(table, k), keys, len(names), len(xs), shape) for k in range(blocks)]
    drop_stored(spark, table)
    return Trees(by, xs, names, edges, parts)




def _cells(df: DataFrame, by: list[str], keys: list[str], xs: list[str], edges: list[np.ndarray],
           models: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The stored cells: group (as text), ranges, training marks, count and target sums per model."""
    @F.pandas_udf("binary")
    def cut(rows: pd.DataFrame) -> pd.Series:
        found = ranges(rows.to_numpy(dtype=float), edges)
        return pd.Series([r.tobytes() for r in found])

    mark = F.concat(*[F.when(F.coalesce(on, F.lit(False)) & target.isNotNull(), F.lit("1")).otherwise(F.lit("0")) for target, on in models.values()])
    targets = [target.cast("double").alias(f"t{j}") for j, (target, _) in enumerate(models.values())]
    rows = df.select(*[key_text(c).alias(k) for c, k in zip(by, keys)], cut(F.struct(*[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)])).alias("bins"),
                     mark.alias("train"), *targets).where(F.col("train").contains("1"))
    sums = [F.coalesce(F.sum(f"t{j}"), F.lit(0.0)).alias(f"t{j}") for j in range(len(models))]
    return stored(rows.groupBy(*keys, "bins", "train").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "cells")


def cells_of(batch: pa.RecordBatch | pa.Table, at: np.ndarray, models: int, width: int) -> Cells:
    """The cells in rows ``at``."""
    pick = pa.array(at)

    def column(name: str) -> pa.Array:
        c = batch.column(name)
        return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).take(pick)

    bins = np.frombuffer(b"".join(column("bins").to_pylist()), np.uint8).reshape(len(at), width)
    train = np.frombuffer("".join(column("train").to_pylist()).encode(), np.uint8).reshape(len(at), models) - ord("0")
    target = np.stack([column(f"t{j}").to_numpy(zero_copy_only=False) for j in range(models)], axis=1)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64), 17) | np.uint64(1)
    code = (bins.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    return Cells(bins, column("n").to_numpy(zero_copy_only=False), target, train, mixed(code, 3), np.zeros((len(at), models)))


def _in_tasks(table: DataFrame, keys: list[str], models: int, width: int, shape: Shape) -> dict[tuple, Ensemble]:
    """Every group's trees in a task of its own."""
    schema = StructType([*table.select(*keys).schema.fields, StructField("trees", BinaryType())])

    def run(group: pa.Table) -> pa.Table:
        grown = grown_in_task(cells_of(group, np.arange(group.num_rows), models, width), shape)
        first = [group.column(k).slice(0, 1).combine_chunks() for k in keys]
        return pa.table([*first, pa.array([pickle.dumps(grown)], pa.binary())], [*keys, "trees"])

    rows = table.groupBy(*keys).applyInArrow(run, schema).collect()
    return {tuple(r[k] for k in keys): pickle.loads(r["trees"]) for r in rows}


def _in_passes(table: DataFrame, keys: list[str], models: int, width: int, shape: Shape) -> dict[tuple, Ensemble]:
    """Level by level over all cells; what a pass reads of earlier trees is stored with the cells every REWRITE trees."""
    sc = table.sparkSession.sparkContext
    whole = table.groupBy(*keys).agg(*[F.sum(F.when(F.substring("train", j + 1, 1) == "1", F.col(c))).alias(f"{c}_{j}" if c == "n" else f"t_{j}")
                                       for j in range(models) for c in ("n", f"t{j}")]).collect()
    found = {}
    for r in whole:
        n, t = (np.array([r[f"{c}_{j}"] or 0.0 for j in range(models)]) for c in ("n", "t"))
        found[tuple(r[k] for k in keys)] = Ensemble(models, shape, starts(shape, n, t))
    schema = StructType([*table.schema.fields, StructField("score", BinaryType())])
    kept, names = table.columns, schema.names
    done, cells = 0, None

    def scores(batch: pa.RecordBatch, at: np.ndarray, c: Cells, grown: Ensemble) -> np.ndarray:
        if "score" not in batch.schema.names:
            return np.tile(grown.start, (len(at), 1))
        return np.frombuffer(b"".join(batch.column("score").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), models).copy()

    def rewritten(before: DataFrame, sent, since: int, upto: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.zeros((batch.num_rows, models))
                for key, at in groups_of(batch, keys):
                    grown = sent.value[key]
                    c = cells_of(batch, at, models, width)
                    score[at] = scores(batch, at, c, grown)
                    for m in range(models):
                        score[at, m] += shape.rate * grown.score(m, c.bins, range(since, upto))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([r.tobytes() for r in score], pa.binary())], names)

        return stored(before.mapInArrow(run, schema), "cells")

    for tree in range(shape.trees):
        if shape.loss != "mean" and tree - done >= REWRITE:
            sent = sc.broadcast(found)
            after = rewritten(cells if cells is not None else table, sent, done, tree)
            if cells is not None:
                drop_stored(table.sparkSession, cells)
            cells, done = after, tree
        for level in range(shape.depth):
            sent = sc.broadcast(found)
            source = cells if cells is not None else table
            for key, v in _level_sums(source, keys, sent, models, width, tree, level, done, scores).items():
                grow(found[key], tree, level, v.reshape(models, 1 << level, width, BINS, 3))
            sent.unpersist()
    if cells is not None:
        drop_stored(table.sparkSession, cells)
    return found


def _level_sums(source: DataFrame, keys: list[str], sent, models: int, width: int, tree: int, level: int, done: int, scores) -> dict[tuple, np.ndarray]:
    """The histogram of every group, added up over all cells by (group, place)."""
    schema = StructType([*source.select(*keys).schema.fields, StructField("place", LongType()), StructField("v", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, at in groups_of(batch, keys):
                c = cells_of(batch, at, models, width)
                c.score = scores(batch, at, c, sent.value[key])
                part = histogram(c, sent.value[key], tree, level, done).ravel()
                total[key] = total[key] + part if key in total else part
        for key, part in total.items():
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(at), pa.string()) for k in key), pa.array(at), pa.array(part[at])], [*keys, "place", "v"])

    rows = source.mapInArrow(run, schema).groupBy(*keys, "place").agg(F.sum("v").alias("v"))
    arrays = rows.groupBy(*keys).agg(F.collect_list("place").alias("place"), F.collect_list("v").alias("v")).collect()
    out = {}
    for r in arrays:
        v = np.zeros(models * (1 << level) * width * BINS * 3)
        v[np.array(r["place"], np.int64)] = r["v"]
        out[tuple(r[k] for k in keys)] = v
    return out
