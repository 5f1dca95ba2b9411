"""Whitening against a dense eigendecomposition; rank-one updates against refitting."""

import math
from fractions import Fraction

import numpy as np
import pytest

from panelfx.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def check(spark, rows, got, components=4):
    """``rows``: (id, vector) of all rows; ``got``: collected result."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, d = len(distinct), len(distinct[0])
    total = [sum(c) for c in zip(*distinct)]
    mean = np.array([float(Fraction(t, n)) for t in total])
    fit = np.array(distinct, float) - mean
    cov = fit.T @ fit / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == keep * len(usable)
    by_id = {}
    for i, x in usable:
        by_id.setdefault(i, []).append(x)
    found = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for (i, k), r in found.items():
        xs = by_id[i]
        assert r.n == n and r.explained == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-9
        if len(xs) > 1:
            continue
        assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(xs[0], total))
        want = (np.array(xs[0]) - mean) @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        if abs(want) > 1e-6:
            signs.setdefault(k, set()).add(np.sign(want) == np.sign(r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-8)
    assert all(len(s) == 1 for s in signs.values())
    return d


def test_given_vectors(spark):
    df = queries.table(spark, SF, "embeddings")
    assert check(spark, [(r.vec_id, r.embedding) for r in df.collect()], whitening.whitened(df).collect()) == 64


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=3) * (3, 1, 0.5)]) for k in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [1.0, None, 2.0]), (105, [float("nan"), 0.0, 0.0]), (106, [float("inf"), 0.0, 0.0]),
             (107, [-float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (108, [0.1, -0.0, 1e-9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, x string").repartition(7)
    check(spark, rows, whitening.whitened(df).collect())
    # a vector of another length than most goes
    other = df.unionByName(spark.createDataFrame([(200, [1.0, 2.0], 1, "x")], df.schema))
    assert 200 not in {r.vec_id for r in whitening.whitened(other).collect()}


def test_without_variance(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]):
        got = whitening.whitened(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and got.columns[:3] == ["vec_id", "component", "n"]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(5)], schema)
    assert {r.component for r in whitening.whitened(line).collect()} == {1}  # the second has no variance


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [2.0 ** (40 + k % 3), float(k)], 0) for k in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert got and all(r.deviation is None for r in got)
    assert whitening.deviations(np.array([[3, 4]]), 2, [1, 2]) == [25 + 36]


def test_groups_of_spectra_in_rounds(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in rng.normal(size=6) * np.arange(1, 7)]) for k in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(23)
    x = np.floor(256 * np.array([v for _, v in rows]))
    mean = x.mean(axis=0)
    fit, size = whitening.scaled(df)
    parts = whitening.spectra(fit.select("x"), mean)
    got = whitening.combined(parts, fan_in=3).collect()
    assert len(got) == 1 and got[0].n == 300 and size == 6
    scatter = (x - mean).T @ (x - mean)
    vectors = np.array(got[0].vecs).reshape(6, 6)
    assert np.allclose(vectors @ np.diag(got[0].vals) @ vectors.T, scatter, rtol=0, atol=1e-12 * np.trace(scatter))


def spectrum(x):
    s = whitening.Spectrum.empty(x.shape[1])
    for r in x:
        s.add(r)
    return s


@pytest.mark.parametrize("case", ["plain", "equal", "few", "constant", "tiny", "huge", "copies"])
def test_rank_one_updates_are_the_decomposition(case):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 12))
    if case == "equal":
        x = np.concatenate([np.eye(12), -np.eye(12)] * 3)
    elif case == "few":
        x = x[:5]
    elif case == "constant":
        x[:, 3] = 2.0
        x[:, 7] = x[:, 2]
    elif case == "tiny":
        x[:, :6] *= 1e-7
    elif case == "huge":
        x *= 1e9
    elif case == "copies":
        x = np.repeat(x[:4], 30, axis=0)
    mean = x.mean(axis=0)
    scatter = (x - mean).T @ (x - mean)
    top = np.linalg.eigvalsh(scatter)[-1]
    half = spectrum(x[: len(x) // 3])
    half.merge(spectrum(x[len(x) // 3:]))
    for s in (spectrum(x), half):
        assert s.n == len(x) and np.allclose(s.mean, mean, atol=1e-9 * max(1, abs(mean).max()))
        assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-12
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() < 1e-12 * top


def test_secular_roots():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 40):
        d = np.sort(rng.normal(size=k))
        z = rng.normal(size=k)
        diff, roots = whitening.secular(d, z * z)
        assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), atol=1e-13)
        assert np.allclose(diff, d[:, None] - roots, atol=1e-13)
