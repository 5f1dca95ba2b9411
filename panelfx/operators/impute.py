"""Missing-value imputation (#71-76).

Multiple imputation keeps all M completed copies in one DataFrame keyed by
``m`` (stacked with ``explode``), so every chain step is one grouped job
over all imputations instead of M separate runs.

Chained equations (``impute_chained``), default ``learner="bayes"``: start
from medians; each sweep visits the incomplete columns in ascending order of
missingness and, per imputation m, regresses the column on its predictors
over the rows where it was observed: grouped cross-product sums (``gram``) and
a small Bayesian-ridge evidence fit per m.  A missing cell is drawn from its
predictive distribution: mean x'b and variance 1/alpha + x' Cov x (x less the
training means), with a normal draw from a hash of (seed, m, sweep, column,
row key).  Draws are deterministic, so a recomputed partition after an
executor loss reproduces the same values.

Rows without a missing cell among the chain's columns are the same in every
imputation.  Their cross products are summed once; only the incomplete rows
are copied M times, as a narrow table (row number, m, chain columns), and are
stored after every few columns.  The other columns are joined back at the end.

``learner="forest"``: random forests of all imputations grown together, no
predictive draw (reproduces the forest variant, which understates
between-imputation variance).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored
from .gram import gram_sums, gram_sums_many
from .learners import join_on_keys
from .quantiles import exact_percentiles


def stack_imputations(df: DataFrame, M: int, m_col: str = "m") -> DataFrame:
    """#76: M copies keyed by ``m`` = 1..M (a generator, no join)."""
    return df.withColumn(m_col, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(int(M)).cast("long"))))


def impute_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """#71: per-column median (exact, interpolated) filled into missing cells."""
    stats = exact_percentiles(df, cols, [0.5], by).select(*by, *[F.element_at(c, 1).alias(f"_med_{c}") for c in cols])
    out = join_on_keys(df, stats, list(by), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """#72: per-column mean filled into missing cells."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_avg_{c}") for c in cols])
    out = join_on_keys(df, stats, list(by), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_avg_{c}")) for c in cols}).drop(
        *[f"_avg_{c}" for c in cols])


def missing_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Missing count per column from one aggregation (one row of p numbers
    reaches the driver)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def drop_all_missing_columns(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """#73: columns without any value leave the table."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    empty = [c for c in cols if row[c] == 0]
    return (df.drop(*empty) if empty else df), empty


def hash_normal(*parts: Column | str) -> Column:
    """Standard normal draw from two 53-bit hash uniforms (Box-Muller)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    two53 = float(2 ** 53)

    def u(salt: str) -> Column:
        h = F.xxhash64(F.lit(salt), *cols)
        return (F.pmod(h, F.lit(2 ** 53).cast("long")).cast("double") + F.lit(0.5)) / F.lit(two53)

    return F.sqrt(F.lit(-2.0) * F.ln(u("a"))) * F.cos(F.lit(2.0 * math.pi) * u("b"))


def bayes_ridge_from_gram(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, tol: float = 1e-3,
                          max_iter: int = 300, a1: float = 1e-6, a2: float = 1e-6, l1: float = 1e-6,
                          l2: float = 1e-6):
    """Evidence maximisation of a Bayesian ridge with intercept, from the sums
    of an intercept-first design.  Returns (intercept, coef, posterior cov of
    coef, noise precision alpha, x means)."""
    q = len(xty)
    xbar = xtx[0, 1:] / n
    ybar = xty[0] / n
    Sxx = xtx[1:, 1:] - n * np.outer(xbar, xbar)
    Sxy = xty[1:] - n * xbar * ybar
    Syy = yty - n * ybar * ybar
    p = q - 1
    if p == 0:
        alpha = (n + 2 * a1) / (max(Syy, 1e-300) + 2 * a2)
        return ybar, np.zeros(0), np.zeros((0, 0)), alpha, xbar
    e, V = np.linalg.eigh((Sxx + Sxx.T) / 2)
    e = np.clip(e, 0.0, None)
    alpha = 1.0 / (Syy / n + 1e-12) if Syy > 0 else 1.0
    lam = 1.0
    coef = np.zeros(p)
    Vty = V.T @ Sxy
    for _ in range(max_iter):
        new = V @ (Vty / (e + lam / alpha))
        rss = float(Syy - 2 * new @ Sxy + new @ Sxx @ new)
        gamma = float(np.sum(alpha * e / (lam + alpha * e)))
        lam = (gamma + 2 * l1) / (float(new @ new) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (max(rss, 0.0) + 2 * a2)
        done = np.sum(np.abs(coef - new)) < tol
        coef = new
        if done:
            break
    cov = (V / (lam + alpha * e)) @ V.T
    intercept = ybar - xbar @ coef
    return intercept, coef, cov, alpha, xbar


def predictive(sums: np.ndarray) -> list[float]:
    """From n, xtx, xty, yty of one regression: intercept and coefficients, regressor means, 1 / alpha, and the lower triangle (row by row) of L with Cov = L L'."""
    q = int(round((-1 + math.sqrt(1 + 4 * (len(sums) - 2))) / 2))
    b0, coef, cov, alpha, xbar = bayes_ridge_from_gram(sums[1:1 + q * q].reshape(q, q), sums[1 + q * q:-1], float(sums[-1]), float(sums[0]))
    factor = np.linalg.cholesky((cov + cov.T) / 2 + 1e-14 * np.eye(len(coef)) * max(1e-300, np.abs(cov).max())) if len(coef) else np.zeros((0, 0))
    return [float(b0), *map(float, coef), *map(float, xbar), float(1.0 / alpha), *map(float, factor[np.tril_indices(len(coef))])]


def predictive_size(p: int) -> int:
    return 1 + p + p + 1 + p * (p + 1) // 2


def predictive_draw(xs: Sequence[Column], fit: Callable[[int], Column], normal: Column) -> Column:
    """Mean plus a normal draw with the variance 1/alpha + |L'(x - means)|^2 of the row; ``fit(i)``: number i of ``predictive``."""
    p = len(xs)
    mean = fit(0)
    for i, x in enumerate(xs):
        mean = mean + fit(i + 1) * x
    away = [x - fit(1 + p + i) for i, x in enumerate(xs)]
    variance = fit(1 + 2 * p)
    for j in range(p):
        side = F.lit(0.0)
        for i in range(j, p):
            side = side + fit(2 + 2 * p + i * (i + 1) // 2 + j) * away[i]
        variance = variance + side * side
    return mean + F.sqrt(variance) * normal


# The reference's imputation forest (fixed values).
IMPUTE_FOREST = dict(trees=10, depth=5, loss="mean")


def forest_fill(data: DataFrame, col: str, xs: Sequence[str], obs_col: str, m_col: str, seed: int, **params) -> DataFrame:
    """One chained step of the forest imputer: the forests of all imputations, fitted on the observed rows, predict the missing ones."""
    from .trees import Shape, fit_trees
    forest = fit_trees(data, xs, {"_fill": (F.col(col), F.col(obs_col))}, [m_col], Shape(**{**IMPUTE_FOREST, "seed": seed, **params}))
    return forest.predict(data).withColumn(col, F.when(F.col(obs_col), F.col(col)).otherwise(F.coalesce(F.col("_fill"), F.col(col)))).drop("_fill")


def _nearest_predictors(df: DataFrame, targets: Sequence[str], pool: Sequence[str], k: int) -> dict[str, list[str]]:
    """Top-k predictors by absolute correlation with each target; all others
    when ``k`` is 0 or large enough.  The correlations come from one
    cross-product aggregation: (p+1)^2 numbers, p columns of the table."""
    cands = {t: [c for c in pool if c != t] for t in targets}
    if not k or all(len(c) <= k for c in cands.values()):
        return cands
    cols = list(dict.fromkeys([*targets, *pool]))
    sums = gram_sums(df, cols[0], cols).first()
    if sums is None:
        return {t: c[:k] for t, c in cands.items()}
    q = len(cols) + 1
    xtx = np.asarray(sums["xtx"], dtype=float).reshape(q, q)
    cov = xtx[1:, 1:] / xtx[0, 0] - np.outer(xtx[0, 1:], xtx[0, 1:]) / xtx[0, 0] ** 2
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(np.abs(cov / np.outer(sd, sd)))
    at = {c: i for i, c in enumerate(cols)}
    return {t: sorted(c, key=lambda x: (-corr[at[t], at[x]], x))[:k] for t, c in cands.items()}


WIDTH = 8  # columns of a sweep between two stored states


def impute_chained(df: DataFrame, cols: Sequence[str], M: int = 5, max_iter: int = 5, learner: str = "bayes",
                   extra_predictors: Sequence[str] = (), n_nearest: int | None = 10, row_key: Sequence[str] = (),
                   seed: int = 0, m_col: str = "m", forest_params: dict | None = None, schedule: str = "gauss-seidel") -> DataFrame:
    """#74 / #75: chained-equation multiple imputation of ``cols``.

    ``extra_predictors`` (e.g. the outcome) help predict but are never
    imputed; columns held out of the chain (ids, treatment codes) are simply
    not listed.  ``row_key`` identifies a row for the noise draws.
    ``schedule="jacobi"`` (Bayes learner) updates every column from the
    previous sweep's values: one aggregation per sweep instead of one per
    column, for wide tables.
    Columns of ``cols`` without any value leave the table first.  A model is
    fitted on the rows where its column was observed and its predictors are
    present; a missing cell without a prediction (a predictor that is not
    imputed is missing there, or there is no row to fit) keeps its start
    value, so that no cell of the chain stays missing.
    Returns the stacked table with ``m`` and completed ``cols``."""
    if learner not in ("bayes", "forest"):
        raise ValueError(f"unknown imputation learner {learner!r}")
    df, empty = drop_all_missing_columns(df, list(cols))
    cols = [c for c in cols if c not in empty]
    extra = [c for c in dict.fromkeys(extra_predictors) if c not in empty and c not in cols]
    key = list(row_key) if row_key else [c for c in df.columns if c not in cols][:2]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    base = stored(df.withColumns({"_row": F.monotonically_increasing_id(), "_whole": whole}), "impute")
    miss = missing_counts(base, cols)
    targets = sorted([c for c in cols if miss[c] > 0], key=lambda c: (miss[c], c))   # skip complete, ascending
    if not targets:
        return stack_imputations(base.drop("_row", "_whole"), M, m_col)
    meds = exact_percentiles(base, targets, [0.5]).first()
    start = {c: F.coalesce(F.col(c).cast("double"), F.lit(meds[c][0])) for c in targets}
    pool = cols + extra
    preds = _nearest_predictors(base.withColumns(start), targets, pool, n_nearest if learner == "bayes" else 0)
    if learner == "forest":
        return _forest_chain(base, targets, preds, M, max_iter, m_col, seed, forest_params or {}, start)
    chain = {c: f"_c{i}" for i, c in enumerate(pool)}
    state = base.where("not _whole").select(
        "_row", F.xxhash64(*key).alias("_hash"), *[(start.get(c, F.col(c).cast("double"))).alias(n) for c, n in chain.items()],
        *[F.col(c).isNotNull().alias(f"_obs{j}") for j, c in enumerate(targets)])
    # Every pass computes on these rows, so they are dealt evenly, once.
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = stored(stack_imputations(state, M, m_col).repartition(parts, "_row", m_col), "impute")
    models = {chain[c]: [chain[x] for x in preds[c]] for c in targets}
    fixed = {target: sums for (_, target), sums in gram_sums_many(
        base.where("_whole").select(F.lit(0).alias("_one"), *[F.col(c).cast("double").alias(n) for c, n in chain.items()]),
        {n: (xs, F.lit(True)) for n, xs in models.items()}, "_one").items()}
    for sweep in range(1, max_iter + 1):
        steps = [list(enumerate(targets))] if schedule == "jacobi" else [[(j, c)] for j, c in enumerate(targets)]
        after = state
        for k, step in enumerate(steps):
            salts = [(seed * 1_000_003 + sweep) * 10_007 + j for j, _ in step]
            after = _drawn(after, [(j, chain[c], models[chain[c]]) for j, c in step], fixed, M, m_col, salts)
            if k % WIDTH == WIDTH - 1 and k + 1 < len(steps):
                state = after = _advance(state, after)
        state = _advance(state, after)
    done = state.select("_row", m_col, *[F.col(chain[c]).alias(f"_new{j}") for j, c in enumerate(targets)])
    incomplete = base.where("not _whole").join(done, "_row")
    incomplete = incomplete.withColumns({c: F.col(f"_new{j}") for j, c in enumerate(targets)})
    complete = stack_imputations(base.where("_whole").withColumns({c: F.col(c).cast("double") for c in targets}), M, m_col)
    names = [*df.columns, m_col]
    return complete.select(*names).unionByName(incomplete.select(*names))


def _drawn(state: DataFrame, targets: list[tuple[int, str, list[str]]], fixed: dict[str, np.ndarray], M: int, m_col: str, salts: list[int]) -> DataFrame:
    """``state`` with the missing cells of the targets (number, column, regressors) drawn anew.

    The fits come from the sums of the complete rows and of the incomplete
    ones: M x targets small vectors, whatever the rows.  With a salt for the
    draws they are one literal, so they are data to the generated code, which
    is compiled once per column and not once per sweep."""
    sums = gram_sums_many(state, {c: (xs, F.col(f"_obs{j}")) for j, c, xs in targets}, m_col)
    numbers: list[float] = []
    for m in range(1, M + 1):
        for (_, c, xs), salt in zip(targets, salts):
            parts = [x for x in (fixed.get(c), sums.get((m, c))) if x is not None]
            numbers += [float(salt), *(predictive(sum(parts)) if parts else [math.nan] * predictive_size(len(xs)))]
    literal = F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")
    width = len(numbers) // M
    first = ((F.col(m_col) - 1) * width).cast("int")
    new = {}
    begin = 0
    for j, c, xs in targets:
        def number(i: int, begin=begin) -> Column:
            return F.get(literal, first + F.lit(begin + i))

        draw = predictive_draw([F.col(x) for x in xs], lambda i, number=number: number(1 + i), hash_normal(number(0).cast("long"), F.col(m_col), "_hash"))
        new[c] = F.when(F.col(f"_obs{j}"), F.col(c)).otherwise(F.coalesce(F.nanvl(draw, F.lit(None).cast("double")), F.col(c)))
        begin += 1 + predictive_size(len(xs))
    return state.withColumns(new)


def _forest_chain(base: DataFrame, targets: list[str], preds: dict[str, list[str]], M: int, max_iter: int, m_col: str, seed: int,
                  params: dict, start: dict[str, Column]) -> DataFrame:
    """The chain with forests, on the stacked table."""
    data = base.withColumns({f"_obs_{c}": F.col(c).isNotNull() for c in targets}).withColumns(start).drop("_row", "_whole")
    data = stored(stack_imputations(data, M, m_col), "impute")
    for sweep in range(1, max_iter + 1):
        for j, c in enumerate(targets):
            data = _advance(data, forest_fill(data, c, preds[c], f"_obs_{c}", m_col, seed + 100 * sweep + j, **params))
    drop_stored(base.sparkSession, base)
    return data.drop(*[f"_obs_{c}" for c in targets])


def _advance(before: DataFrame, after: DataFrame) -> DataFrame:
    """The next state of the chain; its predecessor's files go."""
    state = stored(after, "impute")
    drop_stored(state.sparkSession, before)
    return state
