"""Embedding whitening by incremental eigendecomposition.

Vectors become whole numbers (floor of 256 times each entry).  The covariance
of the distinct ones is never formed: every task keeps the spectrum (count,
mean, eigenvalues and eigenvectors of the centred scatter) of the vectors it
has seen, and takes up one more by a rank-one update.  The update's eigenvalues
solve the secular equation 1 + rho * sum z_i^2 / (d_i - mu) = 0; entries with a
vanishing z_i, or with equal d_i after a reflection, are deflated first.
Spectra of tasks are combined in groups of ``FAN_IN``, one spectrum taken up by
the other by one rank-one update per eigenvector and one for the distance of
the means, until one is left.

The leading vectors of that spectrum then span a subspace on which the exact
covariance is projected in one pass over the vectors (Rayleigh-Ritz).  The pass
also gives the residuals; while one is above ``TOLERANCE``, the residuals join
the subspace and the pass is made again.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries go, and so do rows whose vector is of another length than most (of
equally many: than the longest); a null key is carried along; equal vectors
count once in the fit and get a row each; entries that leave the range of a
long after scaling take its end; a ``deviation`` beyond a long is null;
components without variance (1e-12 of the first or less) have no rows, so one
distinct vector or an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.session import drop_stored, stored

SCALE = 256
COMPONENTS = 4
SPARE = 12            # further vectors of the first subspace
FAN_IN = 32
ROUNDS = 8            # Rayleigh-Ritz passes at most
TOLERANCE = 4e-15     # residual of an eigenvector, against the largest eigenvalue
NO_VARIANCE = 1e-12   # of a component, against the first
STEPS = 60            # of a secular root; 8 are usual
EPS = np.finfo(np.float64).eps
LONG = (1 << 63) - 1


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2_j / (d_j - mu) = 0 for rising ``d`` and positive ``z2``.

    Root i lies between d_i and d_(i+1); it is given as its distance from the
    nearer of both, so that differences to all ``d`` are exact to rounding.
    Returns these differences d_j - mu_i (row j, column i) and the roots.

    Each step replaces the sums left and right of the root by a constant and
    one pole each, with equal value and slope, and solves the quadratic that
    is left; a step that leaves the bracket becomes a bisection.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    middle = 1.0 + (z2[:, None] / ((d[:, None] - d) - gap / 2)).sum(axis=0)
    high = middle < 0  # the root is in the upper half
    high[-1] = False
    origin = np.where(high, upper, d)
    delta = d[:, None] - origin
    low_pole, high_pole = np.where(high, -gap, 0.0), np.where(high, 0.0, gap)
    lo, hi = np.where(high, -gap / 2, 0.0), np.where(high, 0.0, gap / 2)
    hi[-1] = gap[-1]
    tau = (lo + hi) / 2
    left = np.tri(k, dtype=bool).T  # row j, column i: pole j at or below root i
    active = np.arange(k)
    for _ in range(STEPS):
        t = tau[active]
        diff = delta[:, active] - t
        part = z2[:, None] / diff
        slope = part / diff
        psi = (part * left[:, active]).sum(axis=0)
        whole = part.sum(axis=0)
        f = 1.0 + whole
        size = 1.0 + (whole - 2 * psi)  # the sums have opposite signs
        dpsi = (slope * left[:, active]).sum(axis=0)
        dphi = slope.sum(axis=0) - dpsi
        negative = f < 0
        lo[active[negative]] = t[negative]
        hi[active[~negative]] = t[~negative]
        wide = np.abs(f) > 2 * EPS * k * size
        wide &= hi[active] - lo[active] > EPS * np.abs(t)
        if not wide.any():
            break
        active, t, f, dpsi, dphi = active[wide], t[wide], f[wide], dpsi[wide], dphi[wide]
        a, b = low_pole[active] - t, high_pole[active] - t
        c = f - a * dpsi - b * dphi
        p = (a + b) * f - a * b * (dpsi + dphi)
        q = a * b * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            after = t + step
        bad = ~((after > lo[active]) & (after < hi[active]))
        after[bad] = (lo[active[bad]] + hi[active[bad]]) / 2
        tau[active] = after
    return delta - tau, origin + tau


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(values) vectors' + u u'``."""
    z = u @ vectors
    norm = float(z @ z)
    if not norm > 0:
        return values, vectors
    tol = 8 * EPS * max(abs(values[0]), abs(values[-1]), norm)
    close = np.diff(values) <= tol
    if close.any():
        # Deflation of equal values: a reflection leaves one of each run with all of the run's z.
        vectors = vectors.copy()
        start = 0
        while start < len(values):
            end = int(np.searchsorted(values, values[start] + tol, side="right"))
            if end - start > 1:
                part = z[start:end]
                size = float(np.sqrt(part @ part))
                if size > 0:
                    v = part.copy()
                    v[-1] += np.copysign(size, part[-1])
                    v /= np.sqrt(v @ v)
                    block = vectors[:, start:end]
                    block -= np.outer(2 * (block @ v), v)
                    z[start:end - 1] = 0
                    z[end - 1] = -np.copysign(size, part[-1])
            start = end
    live = np.flatnonzero(np.abs(z) * np.sqrt(norm) > tol)  # deflation of vanishing z
    if not len(live):
        return values, vectors
    d = values[live]
    diff, roots = secular(d, z[live] ** 2)
    # The z that the computed roots belong to exactly keeps the vectors orthogonal.
    ratio = -diff
    spread = d[None, :] - d[:, None]
    np.fill_diagonal(spread, 1.0)
    quotient = ratio / spread
    own = ratio[np.arange(len(d)), np.arange(len(d))].copy()
    np.fill_diagonal(quotient, 1.0)
    exact = np.sqrt(np.abs(own * quotient.prod(axis=1)))
    turn = np.copysign(exact, z[live])[:, None] / diff
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = roots
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of some vectors."""
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt((self.n - 1) / self.n))
        self.mean = self.mean + away / self.n
        if self.n % 1024 == 0:
            self.straighten()

    def merge(self, other: Spectrum) -> None:
        n = self.n + other.n
        if not n:
            return
        away = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt(self.n * other.n / n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n
        self.straighten()

    def straighten(self) -> None:
        """Take off what rounding has bent the eigenvectors."""
        q, r = np.linalg.qr(self.vectors)
        self.vectors = q * np.where(np.diag(r) < 0, -1.0, 1.0)

    def row(self, name: int) -> pa.RecordBatch:
        cells = [name, self.n, self.mean, self.values, self.vectors.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, ROW_TYPES)], ROW_NAMES)

    @classmethod
    def of(cls, n: int, mean: list, values: list, vectors: list) -> Spectrum:
        return cls(n, np.array(mean), np.array(values), np.array(vectors).reshape(len(mean), len(mean)))


ROW_NAMES = ["place", "n", "mean", "vals", "vecs"]
ROW_TYPES = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
ROW_SCHEMA = "place long, n long, mean array<double>, vals array<double>, vecs array<double>"


def scaled(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x, the scaled whole numbers, of the rows with a usable vector, and the vectors' length."""
    c = F.col(vector)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE))
    rows = embeddings.where(usable).select(F.col(key).alias("vec_id"), x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    return rows.where(F.size("x") == size), size


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def widest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def totals(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of the vectors and their exact sum, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = matrix(batch, size)
            if len(x):
                safe = widest(x) * len(x) < 1 << 62
                sums = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, sums)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(t) for t in total])], ["entry", "n", "total"])

    parts = vectors.mapInArrow(run, "entry int, n long, total string")
    rows = parts.groupBy("entry").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("entry").collect()
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def spectra(vectors: DataFrame, mean: np.ndarray) -> DataFrame:
    """One spectrum per task, of its vectors less ``mean``."""
    size = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(size)
        for batch in batches:
            for x in matrix(batch, size) - mean:
                own.add(x)
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    return vectors.mapInArrow(run, ROW_SCHEMA)


def combined(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The spectrum of all vectors, from spectra of bounded groups in rounds."""

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        own = Spectrum.of(*(rows[0][c] for c in ROW_NAMES[1:]))
        for r in rows[1:]:
            own.merge(Spectrum.of(*(r[c] for c in ROW_NAMES[1:])))
        return pa.Table.from_batches([own.row(rows[0]["place"] // fan_in)])

    parts = stored(parts, "spectra")
    while parts.agg(F.max("place")).first()[0]:
        groups = parts.groupBy(F.expr(f"place div {fan_in}")).applyInArrow(join, ROW_SCHEMA)
        parts, last = stored(groups, "spectra"), parts
        drop_stored(parts.sparkSession, last)
    return parts


def leading(spectrum: DataFrame, size: int, most: int) -> np.ndarray:
    """The eigenvectors (columns) with the largest eigenvalues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vectors in batch.column("vecs"):
                kept = vectors.values.to_numpy().reshape(size, size)[:, ::-1][:, :most]
                yield pa.RecordBatch.from_arrays([pa.array([kept.ravel()], pa.list_(pa.float64()))], ["vecs"])

    return np.array(spectrum.mapInArrow(run, "vecs array<double>").first()["vecs"]).reshape(size, -1)


def summed(vectors: DataFrame, size: int, cells_of) -> np.ndarray:
    """Sum of ``cells_of(x)``, a flat array, over all vectors: added up in tasks, then per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(matrix(batch, size))
                total = cells if total is None else total + cells
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["cell", "part"])

    rows = vectors.mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["cell"]] = r["total"]
    return out


def refined(vectors: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz: eigenvalues (falling), eigenvectors (columns) and the trace of the covariance."""
    size = len(mean)
    last = np.inf
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0]

        def cells(x: np.ndarray, basis=basis) -> np.ndarray:
            away = x - mean
            return np.append((away.T @ (away @ basis)).ravel(), (away * away).sum())

        got = summed(vectors, size, cells) / n
        image, trace = got[:-1].reshape(size, -1), float(got[-1])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn
        rest = (image @ turn - ritz * values)[:, :components]
        worst = float(np.sqrt((rest * rest).sum(axis=0)).max())
        if basis.shape[1] == size or worst <= TOLERANCE * values[0] or worst > last / 2:
            break
        last = worst
        basis = np.concatenate((ritz, rest / np.maximum(np.sqrt((rest * rest).sum(axis=0)), np.finfo(float).tiny)), axis=1)[:, :size]
    return values[:components], ritz[:, :components], trace


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sum over entries of (n x - total) squared; None beyond a long."""
    if not len(x):
        return []
    reach = n * widest(x) + max(map(abs, total))
    if reach * reach * len(total) <= LONG:
        away = x * n - np.array(total, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.array(total, object)
    return [v if v <= LONG else None for v in (away * away).sum(axis=1).tolist()]


def whitened(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = embeddings.sparkSession
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows, size = scaled(embeddings, key, vector)
    if not size:
        return spark.createDataFrame([], schema)
    fit = stored(rows.select("x").distinct(), "distinct-vectors")
    n, total = totals(fit, size)
    mean = np.array([t / n for t in total])
    spectrum = combined(spectra(fit, mean))
    basis = leading(spectrum, size, min(size, components + SPARE))
    values, axes, trace = refined(fit, mean, n, basis, min(size, components))
    keep = int((values > max(0.0, NO_VARIANCE * values[0])).sum())
    if not keep:
        drop_stored(spark, fit, spectrum)
        return spark.createDataFrame([], schema)
    axes, explained = axes[:, :keep] / np.sqrt(values[:keep]), values[:keep] / trace

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ axes
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    got = summed(fit, size, moments) / n
    spread = got[keep:].reshape(keep, keep) - np.outer(got[:keep], got[:keep])
    error = float(np.abs(spread - np.eye(keep)).max())
    drop_stored(spark, fit, spectrum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, size)
            many = len(x) * keep
            row = pa.array(np.repeat(np.arange(len(x)), keep))
            columns = [batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n, np.int64)),
                       pa.array(deviations(x, n, total), pa.int64()).take(row), pa.array(((x - mean) @ axes).ravel()),
                       pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
