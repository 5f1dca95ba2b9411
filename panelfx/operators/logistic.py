"""Grouped logistic regression by Newton steps (#81, #83).

A model belongs to a group (``by``), leaves out one fold or none, and has a
penalty: sum of log losses + penalty / 2 |b|^2 without the intercept.  All
models take their steps together: one pass over the rows adds up, per group
and model, loss, gradient and weighted cross products at the current
coefficients; converged models and groups are left out of the next pass.  So
the number of jobs is that of the Newton steps, whatever the number of groups,
folds and penalties.

The sums come back to be solved and the coefficients go out again.  Groups are
handled in blocks, so that neither has more than ``SENT_NUMBERS`` numbers at a
time, some 2,000 groups of 50 models and 5 covariates; beyond that the jobs
grow with the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, BooleanType, StructField, StructType

from ..session import drop_stored, stored
from .frame import all_present
from .gram import linear_predictor, unit_diagonal
from .grouped import MATRIX_CELLS, collected, group_block
from .learners import join_on_keys

# The reference's grid (fixed rule): ten penalties 1 / C, C from 1e-4 to 1e4 in equal ratios.
PENALTIES = [10.0 ** (4 - 8 * i / 9) for i in range(10)]
ALL = -1               # fold of a model that leaves none out
STEPS = 60
CONVERGED = 1e-14      # Newton decrement, against the number of rows
SENT_NUMBERS = 4_000_000


@dataclass
class State:
    """The models of a group: accepted coefficients, the ones on trial, and the last full step."""
    folds: np.ndarray
    penalties: np.ndarray
    trial: np.ndarray                      # models x coefficients
    accepted: np.ndarray | None = None
    loss: np.ndarray | None = None
    step: np.ndarray | None = None
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    score: np.ndarray | None = None        # held-out rows, hits and loss per model
    n: np.ndarray | None = None


def sums_at(state: State, data: np.ndarray) -> np.ndarray:
    """Per model: n, loss, gradient, packed cross products, held-out n, hits and loss.  ``data``: fold, target, regressors."""
    m, q = state.trial.shape
    upper = np.triu_indices(q)
    total = np.zeros((m, 2 + q + len(upper[0]) + 3))
    rows = max(1, MATRIX_CELLS // (len(upper[0]) + 4 * m))
    for start in range(0, len(data), rows):
        part = data[start:start + rows]
        X, t = np.column_stack([np.ones(len(part)), part[:, 2:]]), part[:, 1]
        eta = X @ state.trial.T
        loss = np.logaddexp(0, eta) - eta * t[:, None]
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        train = part[:, :1] != state.folds
        weight = np.where(train, p * (1 - p), 0)
        total[:, 0] += train.sum(axis=0)
        total[:, 1] += np.where(train, loss, 0).sum(axis=0)
        total[:, 2:2 + q] += np.where(train, t[:, None] - p, 0).T @ X
        total[:, 2 + q:-3] += weight.T @ (X[:, upper[0]] * X[:, upper[1]])
        total[:, -3] += (~train).sum(axis=0)
        total[:, -2] += (~train & ((eta > 0) == (t[:, None] > 0.5))).sum(axis=0)
        total[:, -1] += np.where(train, 0, loss).sum(axis=0)
    return total.ravel()


def advanced(state: State, sums: np.ndarray) -> State:
    """The state after sums were taken at the trial coefficients: take the trial or halve the step, then step on."""
    m, q = state.trial.shape
    total = sums.reshape(m, -1)
    upper = np.triu_indices(q)
    first = state.accepted is None
    accepted = state.trial.copy() if first else state.accepted.copy()
    step = np.zeros((m, q)) if first else state.step.copy()
    loss = np.full(m, np.inf) if first else state.loss.copy()
    scale = np.ones(m) if first else state.scale.copy()
    done = np.zeros(m, bool) if first else state.done.copy()
    score = np.zeros((m, 3)) if first else state.score.copy()
    n, trial = total[:, 0], state.trial.copy()
    for k in np.flatnonzero(~done):
        now = total[k, 1] + state.penalties[k] / 2 * (trial[k, 1:] @ trial[k, 1:])
        if not now <= loss[k] + 1e-12 * abs(loss[k]) and scale[k] > 1e-9 and np.isfinite(loss[k]):
            scale[k] /= 2
            trial[k] = accepted[k] + scale[k] * step[k]
            continue
        accepted[k], loss[k], scale[k], score[k] = trial[k], now, 1.0, total[k, -3:]
        gradient = total[k, 2:2 + q].copy()
        gradient[1:] -= state.penalties[k] * trial[k, 1:]
        H = np.zeros((q, q))
        H[upper] = total[k, 2 + q:-3]
        H = H + np.triu(H, 1).T + np.diag([0.0] + [state.penalties[k]] * (q - 1))
        scaled, d = unit_diagonal(H)
        step[k] = np.linalg.pinv(scaled, rcond=1e-13, hermitian=True) @ (gradient / d) / d
        if step[k] @ gradient <= CONVERGED * max(n[k], 1.0):
            accepted[k] = accepted[k] + step[k]  # the last step is far below the error of the sums
            done[k] = True
        trial[k] = accepted[k] + (0 if done[k] else step[k])
    return State(state.folds, state.penalties, trial, accepted, loss, step, scale, done, score, n)


def fits(rows: DataFrame, by: Sequence[str], models: dict[tuple, tuple[np.ndarray, np.ndarray]], q: int) -> dict[tuple, State]:
    """Newton steps for the ``models`` (folds and penalties per group); ``rows``: by, fold, target, regressors."""
    by = list(by)
    found = {key: State(f, lam, np.zeros((len(f), q))) for key, (f, lam) in models.items()}
    sc = rows.sparkSession.sparkContext
    for _ in range(STEPS):
        open_ = {key: s for key, s in found.items() if s.accepted is None or not s.done.all()}
        if not open_:
            break
        sent = sc.broadcast(open_)
        got = collected(rows, by, lambda key, data: sums_at(sent.value[key], data) if key in sent.value else None)
        for key, sums in got.items():
            found[key] = advanced(found[key], sums)
        sent.unpersist()
        for key in open_.keys() - got.keys():  # no row: nothing to fit
            found[key].done = np.ones(len(found[key].folds), bool)
            found[key].accepted = found[key].trial
    return found


def prepared(df: DataFrame, t: str, xs: Sequence[str], by: Sequence[str], fold: str | None) -> tuple[DataFrame, list[str]]:
    """The rows that a fit reads, stored once: group, fold, target, regressors."""
    names = [f"_by{i}" for i in range(len(by))]
    key = [F.col(c).alias(n) for c, n in zip(by, names)]
    part = F.col(fold).cast("double") if fold else F.lit(float(ALL) - 1)
    rows = df.where(all_present([t, *xs])).select(*key, part.alias("_fold"), F.col(t).cast("double").alias("_t"),
                                                  *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    return stored(rows, "logistic"), names


def coefficients(df: DataFrame, t: str, xs: Sequence[str], by: Sequence[str], fold: str | None,
                 plan: Callable[[DataFrame, list[str], dict[tuple, int], int], list[tuple]], models: int, extra: list[StructField]) -> DataFrame:
    """Run ``plan`` on the stored rows in blocks of groups; one row per fitted model."""
    spark, by = df.sparkSession, list(by)
    rows, names = prepared(df, t, xs, by, fold)
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    q = len(xs) + 1
    per_group = models * (q * (q + 1) // 2 + 3 * q + 8)
    blocks = max(1, -(-(sizes.count() * per_group) // SENT_NUMBERS)) if by else 1
    take = group_block(names, blocks)
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in by], *extra, StructField("coef", ArrayType(DoubleType())),
                         StructField("n", LongType()), StructField("converged", BooleanType())])
    parts = []
    for block in range(blocks):
        groups = {tuple(r[c] for c in names): r["n"] for r in take(sizes, block).collect()}
        found = plan(take(rows, block), names, groups, q)
        part = spark.createDataFrame(found, schema)
        parts.append(stored(part, "coefficients") if blocks > 1 else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    drop_stored(spark, rows)
    return out


def logistic_fit(df: DataFrame, t: str, xs: Sequence[str], by: Sequence[str] = (), penalty: float = 1.0,
                 fold: str | None = None, folds: int = 0) -> DataFrame:
    """Coefficients (intercept first) per group: ``by``, coef, n, converged.

    With a ``fold`` column a group has one model per fold 0 .. folds - 1,
    fitted on the rows of the other folds, and the result the column ``fold``."""

    def plan(rows, names, groups, q):
        left_out = np.arange(folds) if fold else np.array([ALL])
        found = fits(rows, names, {key: (left_out, np.full(len(left_out), float(penalty))) for key in groups}, q)
        return [(*key, *([int(f)] if fold else []), s.accepted[k].tolist(), int(s.n[k]) if s.n is not None else 0, bool(s.done[k]))
                for key, s in found.items() for k, f in enumerate(left_out)]

    return coefficients(df, t, xs, by, fold, plan, max(folds, 1), [StructField("fold", IntegerType())] if fold else [])


def logistic_cv(df: DataFrame, t: str, xs: Sequence[str], by: Sequence[str] = (), fold: str = "fold", folds: int = 5,
                penalties: Sequence[float] = tuple(PENALTIES), score: str = "accuracy") -> DataFrame:
    """#81: per group the penalty with the best mean held-out score over the
    folds (``accuracy``, the reference's; or ``log_loss``; of equals the
    largest penalty), refitted on all rows: ``by``, penalty, coef, n, converged."""
    grid = np.array(sorted(penalties, reverse=True), float)

    def plan(rows, names, groups, q):
        left_out, lam = np.repeat(np.arange(folds), len(grid)), np.tile(grid, folds)
        first = fits(rows, names, {key: (left_out, lam) for key in groups}, q)
        best = {}
        for key, s in first.items():
            held = s.score if s.score is not None else np.zeros((len(lam), 3))
            value = np.where(held[:, 0] > 0, (held[:, 1] if score == "accuracy" else -held[:, 2]) / np.maximum(held[:, 0], 1), 0)
            best[key] = float(grid[int(np.argmax(np.round(value.reshape(folds, -1).mean(axis=0), 12)))])
        again = fits(rows, names, {key: (np.array([ALL]), np.array([lam])) for key, lam in best.items()}, q)
        return [(*key, best[key], s.accepted[0].tolist(), int(s.n[0]) if s.n is not None else 0, bool(s.done[0])) for key, s in again.items()]

    if score not in ("accuracy", "log_loss"):
        raise ValueError(f"unknown score {score!r}")
    return coefficients(df, t, xs, by, fold, plan, folds * len(grid), [StructField("penalty", DoubleType())])


def probability(coef: str, xs: Sequence[str]):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_predictor(coef, xs)))


def logistic_predict(df: DataFrame, coefs: DataFrame, xs: Sequence[str], by: Sequence[str] = (), out: str = "ps") -> DataFrame:
    """Probability of every row by the coefficients of its group."""
    joined = join_on_keys(df, coefs.select(*by, F.col("coef").alias("_coef")), list(by), "left")
    return joined.withColumn(out, probability("_coef", xs)).drop("_coef")
