"""Grouped least squares from cross-product sums.

The rows never leave the executors: each group contributes its sums of
products (Z'Z, Z'y, y'y, n), and only the (p+1)^2 sums per group reach the
solver.  The solve is a small pseudo-inverse per group in ``applyInPandas``
over the one-row-per-group sums table, so any number of groups (imputations,
folds, replicates) is one job.  Rank-deficient designs get the minimum-norm
solution and ``identified = false``.

A task multiplies its Arrow batches, one matrix product per group and batch,
at every width, which keeps the plan free of thousands of aggregate
expressions; the sums are added by (group, cell) (see ``grouped``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from .frame import all_present
from .grouped import collected, summed


def cross_products(X: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """n, X'X, X'y and y'y in a row."""
    Xw, yw = (X, y) if w is None else (X * w[:, None], y * w)
    n = float(len(y)) if w is None else float(w.sum())
    return np.concatenate([[n], (Xw.T @ X).ravel(), Xw.T @ y, [float(yw @ y)]])


def gram_sums(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True,
              weight: str | None = None, train: Column | None = None) -> DataFrame:
    """One row per group: n, xtx (flattened (q x q), q = len(xs)+intercept),
    xty (q), yty.  Rows with any missing y/x are left out."""
    by, xs = list(by), list(xs)
    ok = all_present([y, *xs])
    if train is not None:
        ok = ok & train
    key = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    w = [F.col(weight).cast("double").alias("_w")] if weight else []
    rows = df.where(ok).select(*key, *w, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    q, first = len(xs) + int(intercept), len(w)

    def sums(_, data: np.ndarray) -> np.ndarray:
        X = data[:, first + 1:]
        X = np.column_stack([np.ones(len(X)), X]) if intercept else X
        return cross_products(X, data[:, first], data[:, 0] if first else None)

    packed = summed(rows, [f"_by{i}" for i in range(len(by))], sums)
    v = F.col("v")
    return packed.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], v.getItem(0).alias("n"),
                         F.slice(v, 2, q * q).alias("xtx"), F.slice(v, 2 + q * q, q).alias("xty"),
                         v.getItem(1 + q * q + q).alias("yty"))


def gram_sums_many(df: DataFrame, models: dict[str, tuple[Sequence[str], Column]], by: str) -> dict[tuple, np.ndarray]:
    """(group, target) -> n, xtx, xty and yty of several regressions, from one pass over the rows.

    ``models``: per target its regressors and the rows to train on.  Designs
    have the intercept first; rows with a missing regressor of a model are
    left out of that model.  For few groups: the sums come to the driver."""
    cols = sorted({c for t, (xs, _) in models.items() for c in [t, *xs]})
    rows = df.select(F.col(by).alias("_by"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
                     *[train.cast("double").alias(f"_on{j}") for j, (_, train) in enumerate(models.values())])
    at = {c: i for i, c in enumerate(cols)}
    places = [[at[t], *(at[x] for x in xs)] for t, (xs, _) in models.items()]

    def sums(_, data: np.ndarray) -> np.ndarray:
        out = []
        for j, place in enumerate(places):
            part = data[data[:, len(cols) + j] == 1][:, place]
            part = part[~np.isnan(part).any(axis=1)]
            out.append(cross_products(np.column_stack([np.ones(len(part)), part[:, 1:]]), part[:, 0]))
        return np.concatenate(out)

    ends = np.cumsum([len(p) ** 2 + len(p) + 2 for p in places])
    return {(key[0], target): part for key, v in collected(rows, ["_by"], sums).items()
            for target, part in zip(models, np.split(v, ends[:-1])) if part[0] > 0}


def _solve_schema(by_fields) -> StructType:
    return StructType(list(by_fields) + [
        StructField("n", DoubleType()), StructField("coef", ArrayType(DoubleType())),
        StructField("inv_diag", ArrayType(DoubleType())), StructField("rank", IntegerType()),
        StructField("identified", BooleanType()), StructField("rss", DoubleType()),
        StructField("tss", DoubleType()), StructField("r2", DoubleType())])


def unit_diagonal(A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``A`` with its rows and columns scaled to a unit diagonal (far better conditioned for polynomial terms), and the scales."""
    d = np.sqrt(np.clip(np.diag(A), 1e-300, None))
    return A / np.outer(d, d), d


def solve(gram: DataFrame, by: Sequence[str] = (), intercept: bool = True, rcond: float = 1e-10) -> DataFrame:
    """Coefficients per group from ``gram_sums`` (pseudo-inverse; rank check).

    The input holds one row per group, so each Python call sees one tiny
    row: the data never passes through the driver or one task."""
    by = list(by)
    schema = _solve_schema([f for f in gram.select(*by).schema.fields])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        xty = np.asarray(r["xty"], dtype=float)
        q = len(xty)
        A = np.asarray(r["xtx"], dtype=float).reshape(q, q)
        n, yty = float(r["n"]), float(r["yty"])
        As, d = unit_diagonal(A)
        inv_s = np.linalg.pinv(As, rcond=rcond, hermitian=True)
        rank = int(np.linalg.matrix_rank(As, tol=rcond * max(1.0, np.abs(As).max())))
        inv = inv_s / np.outer(d, d)
        b = inv @ xty
        rss = float(yty - 2 * b @ xty + b @ A @ b)
        ybar = xty[0] / n if intercept and n else 0.0
        tss = float(yty - n * ybar * ybar) if intercept else yty
        out = {k: [r[k]] for k in by}
        out.update(n=[n], coef=[b.tolist()], inv_diag=[np.diag(inv).tolist()], rank=[rank],
                   identified=[rank == q], rss=[max(rss, 0.0)], tss=[tss],
                   r2=[1.0 - max(rss, 0.0) / tss if tss > 0 else None])
        return pd.DataFrame(out)

    keyed = gram if by else gram.withColumn("_g", F.lit(0))
    res = keyed.groupBy(*(by or ["_g"])).applyInPandas(
        fn if by else (lambda p: fn(p.drop(columns=["_g"]))), schema if by else schema)
    return res


def predict(df: DataFrame, coefs: DataFrame, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True,
            out: str = "pred") -> DataFrame:
    """Attach the group's coefficients (one row per group) and evaluate the
    linear predictor as a column expression."""
    from .learners import join_on_keys
    c = coefs.select(*by, F.col("coef").alias("_coef"))
    joined = join_on_keys(df, c, list(by), "left")
    return joined.withColumn(out, linear_predictor("_coef", xs, intercept)).drop("_coef")


def linear_predictor(coef: str, xs: Sequence[str], intercept: bool = True) -> Column:
    """The coefficients in the array column ``coef`` times the columns ``xs``."""
    terms = [F.get(F.col(coef), F.lit(0))] if intercept else []
    terms += [F.get(F.col(coef), F.lit(i + int(intercept))) * F.col(x) for i, x in enumerate(xs)]
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    return expr


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True,
        train: Column | None = None, weight: str | None = None) -> DataFrame:
    """#78: coefficients, rank, R^2 per group."""
    return solve(gram_sums(df, y, xs, by, intercept, weight, train), by, intercept)


def ols_fit_predict(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (),
                    train: Column | str | None = None, out: str = "pred", intercept: bool = True) -> DataFrame:
    """``linear`` learner: fit on the training rows, predict every row."""
    tr = F.expr(train) if isinstance(train, str) else train
    coefs = ols(df, y, xs, by, intercept, tr)
    return predict(df, coefs, xs, by, intercept, out)
