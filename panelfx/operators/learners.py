"""Nuisance learners with one contract:

    fit_predict(df, target, features, learner, train=None, by=()) -> df + "pred"

``cell``    mean of the target per covariate cell (within ``by``) over the
            training rows; a cell without training rows gets the mean over
            its ``by`` group, a group without any gets 0.  One aggregation,
            SQL-checkable, any number of groups in one job.
``linear``  least squares per ``by`` group from grouped cross-product sums
            (see ``gram``); any number of groups in one job.
``logistic``  penalised logistic regression by Newton steps of all groups
            together (see ``logistic``).
``gbt`` / ``forest``  histogram trees of all groups and models together (see
            ``trees``).
``ensemble``  mean of ``logistic`` (penalty by cross-validation) and ``gbt``.

``propensity`` and ``outcome_models`` are the reference's two steps with its
settings; ``nuisances`` gives all three columns of any estimator, and
``crossfit_nuisances`` gives them from models that have not seen the row.

Per-cell tables (one row per cell, bounded by the number of covariate
cells, not by the rows) are checkpointed once, so the input is scanned once
for the aggregation and once for the join back.  They are joined back on
their keys.  They are at most one row
per cell, and AQE turns those joins into broadcast joins from the measured
size of the aggregate; beyond its threshold they stay sort-merge joins (AQE
splits skewed partitions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip_propensity
from ..session import cut_lineage


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match each other (a missing covariate value
    is a cell of its own).  ``<=>`` keys still plan as hash/sort-merge joins."""
    keys = list(keys)
    if not keys:
        # No keys: ``right`` is a single-row global aggregate.
        return left.crossJoin(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else (cond & c)
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def _cond(train: Column | str | None) -> Column:
    if train is None:
        return F.lit(True)
    return F.expr(train) if isinstance(train, str) else train


def cell_fit_predict(df: DataFrame, target: str, cells: Sequence[str], by: Sequence[str] = (),
                     train: Column | str | None = None, out: str = "pred",
                     min_train: int = 0) -> DataFrame:
    """Cell-mean learner.  ``min_train``: cells with at most that many training
    rows use the group mean (small-arm fallback, #87)."""
    by, cells = list(by), list(cells)
    cond = _cond(train) & F.col(target).isNotNull()
    cell = cut_lineage(df.groupBy(*by, *cells)
                       .agg(F.sum(F.when(cond, F.col(target))).alias("_s"),
                            F.count(F.when(cond, F.lit(1))).alias("_n")))
    grp = cell.groupBy(*by).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_g"))
    pred_tab = join_on_keys(cell, grp, by, "left")
    pred_tab = pred_tab.select(*by, *cells, F.when(F.col("_n") > min_train, F.try_divide(F.col("_s"), F.col("_n")))
                               .otherwise(F.coalesce(F.col("_g"), F.lit(0.0))).alias(out))
    return join_on_keys(df, pred_tab, by + cells, "left")


def cell_nuisances(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str],
                   by: Sequence[str] = (), clip: tuple[float, float] | None = (0.01, 0.99),
                   min_train: int = 0) -> DataFrame:
    """Propensity ``ps`` and arm outcome means ``mu1``/``mu0`` from one aggregation.

    Returns ``df`` plus ``ps``, ``mu1``, ``mu0``.
    """
    cell = cut_lineage(cell_moments(df, treatment, outcome, cells, by))
    tab = _cell_predictions(cell, by, cells, clip, min_train)
    return join_on_keys(df, tab.select(*by, *cells, "ps", "mu1", "mu0"), list(by) + list(cells), "left")


def cell_moments(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str],
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, cell): per-arm count, mean and sum of squared deviations
    of the outcome.  Map-side partial aggregation: a hot cell costs one
    partial row per task, never a single task holding the cell."""
    t, y = F.col(treatment), F.col(outcome)
    present = y.isNotNull() & t.isNotNull()
    aggs = []
    for a in (1, 0):
        ya = F.when(present & (t == a), y)
        aggs += [F.count(ya).alias(f"n{a}"), F.avg(ya).alias(f"ybar{a}"),
                 (F.var_pop(ya) * F.count(ya)).alias(f"m2_{a}")]
    return df.groupBy(*by, *cells).agg(*aggs)


def _cell_predictions(cell: DataFrame, by: Sequence[str], cells: Sequence[str],
                      clip: tuple[float, float] | None, min_train: int) -> DataFrame:
    by = list(by)
    grp = cell.groupBy(*by).agg(
        *[F.try_divide(F.sum(F.col(f"n{a}") * F.coalesce(F.col(f"ybar{a}"), F.lit(0.0))), F.sum(f"n{a}")).alias(f"g{a}")
          for a in (1, 0)])
    tab = join_on_keys(cell, grp, by, "left")
    ps_raw = F.try_divide(F.col("n1"), F.col("n1") + F.col("n0"))
    ps = clip_propensity(ps_raw, *clip) if clip else ps_raw
    mus = [F.when(F.col(f"n{a}") > min_train, F.col(f"ybar{a}"))
           .otherwise(F.coalesce(F.col(f"g{a}"), F.lit(0.0))).alias(f"mu{a}") for a in (1, 0)]
    return tab.select(*by, *cells, "n1", "n0", "ybar1", "ybar0", "m2_1", "m2_0", ps.alias("ps"), *mus)


# Settings of the reference's learners (fixed values).
BOOSTED_PROPENSITY = dict(trees=200, depth=4, rate=0.1, min_leaf=50, loss="logistic")
BOOSTED_OUTCOME = dict(trees=200, depth=4, rate=0.1, min_leaf=20, loss="squared")
FOREST = dict(trees=100, depth=10, loss="mean")
FOLDS = 5


def fit_predict(df: DataFrame, target: str, features: Sequence[str], learner: str = "cell",
                train: Column | str | None = None, by: Sequence[str] = (), out: str = "pred",
                classify: bool = False, seed: int = 42, key: Sequence[str] = (), **params) -> DataFrame:
    """Dispatch to a learner.  Returns ``df`` with an ``out`` column.

    ``key`` names the row for the folds of a cross-validated penalty (the
    covariates where it is not given); ``params`` are those of
    ``trees.Shape``, or ``penalty`` of ``logistic``."""
    if learner == "cell":
        return cell_fit_predict(df, target, features, by, train, out, params.get("min_train", 0))
    if learner == "linear":
        from .gram import ols_fit_predict
        return ols_fit_predict(df, target, features, by=by, train=train, out=out)
    on = F.coalesce(_cond(train), F.lit(False))
    if learner == "logistic":
        from .logistic import logistic_cv, logistic_fit, logistic_predict
        rows = df.where(on)
        if "penalty" in params:
            coefs = logistic_fit(rows, target, features, by, params["penalty"])
        else:
            from .resample import fold_assign
            coefs = logistic_cv(fold_assign(rows, FOLDS, seed, list(key) or list(features), "_fold"), target, features, by, "_fold", FOLDS)
        return logistic_predict(df, coefs, features, by, out)
    if learner in ("gbt", "forest"):
        from .trees import Shape, fit_trees
        base = FOREST if learner == "forest" else BOOSTED_PROPENSITY if classify else BOOSTED_OUTCOME
        trees = fit_trees(df, features, {out: (F.col(target), on)}, by, Shape(**{**base, "seed": seed, **params}))
        return trees.predict(df, [out])
    if learner == "ensemble":
        d = fit_predict(df, target, features, "logistic", train, by, "_e1", True, seed, key)
        d = fit_predict(d, target, features, "gbt", train, by, "_e2", True, seed, key, **params)
        return d.withColumn(out, (F.col("_e1") + F.col("_e2")) / 2).drop("_e1", "_e2")
    raise ValueError(f"unknown learner {learner!r}")


PROPENSITY_METHODS = ("logistic", "gbm", "ensemble")


def propensity(df: DataFrame, t: str, xs: Sequence[str], method: str = "ensemble", by: Sequence[str] = (), out: str = "ps",
               key: Sequence[str] = (), seed: int = 42, **params) -> DataFrame:
    """#83: P(T = 1 | X) by 'logistic' (cross-validated penalty), 'gbm' or their mean 'ensemble'; any other method raises."""
    if method not in PROPENSITY_METHODS:
        raise ValueError(f"unknown method {method!r}")
    return fit_predict(df, t, xs, "gbt" if method == "gbm" else method, by=by, out=out, classify=True, seed=seed, key=key, **params)


def outcome_models(df: DataFrame, t: str, y: str, xs: Sequence[str], learner: str = "gbt", by: Sequence[str] = (), seed: int = 42,
                   **params) -> DataFrame:
    """#84: ``mu1`` and ``mu0``, the outcome models of the treated and the control rows, for every row."""
    if learner in ("gbt", "forest"):
        from .trees import Shape, fit_trees
        arms = {f"mu{a}": (F.col(y), F.col(t) == a) for a in (1, 0)}
        base = FOREST if learner == "forest" else BOOSTED_OUTCOME
        return fit_trees(df, xs, arms, by, Shape(**{**base, "seed": seed, **params})).predict(df)
    for a in (1, 0):
        df = fit_predict(df, y, xs, learner, F.col(t) == a, by, f"mu{a}", seed=seed, **params)
    return df


def nuisances(df: DataFrame, t: str, y: str, xs: Sequence[str], learner: str = "cell", by: Sequence[str] = (),
              clip: tuple[float, float] | None = (0.01, 0.99), key: Sequence[str] = (), seed: int = 42, **params) -> DataFrame:
    """``ps`` (clipped), ``mu1`` and ``mu0`` by one learner; ``logistic`` and
    ``ensemble`` go with linear and boosted outcome models."""
    if learner == "cell":
        return cell_nuisances(df, t, y, xs, by, clip)
    if learner == "linear":
        return linear_nuisances(df, t, y, xs, by, clip)
    if learner == "logistic":
        d = fit_predict(df, t, xs, "logistic", None, by, "ps", True, seed, key, **params)
        d = outcome_models(d, t, y, xs, "linear", by)
    elif learner in ("gbt", "forest", "ensemble"):
        d = fit_predict(df, t, xs, learner, None, by, "ps", True, seed, key, **{k: v for k, v in params.items() if k != "min_leaf"})
        d = outcome_models(d, t, y, xs, "forest" if learner == "forest" else "gbt", by, seed, **params)
    else:
        raise ValueError(f"unknown learner {learner!r}")
    return d.withColumn("ps", clip_propensity("ps", *clip)) if clip else d


def crossfit_nuisances(df: DataFrame, t: str, y: str, xs: Sequence[str], learner: str, fold: str, k: int, by: Sequence[str] = (),
                       clip: tuple[float, float] | None = (0.01, 0.99), min_arm: int = 10, other_arm: str = "folds", seed: int = 42,
                       penalty: float = 1.0, **params) -> DataFrame:
    """#86: ``ps``, ``mu1`` and ``mu0`` of every row from models without the row's fold.

    ``linear`` (propensity by least squares), ``logistic`` (penalised
    propensity, linear outcomes), ``gbt`` and ``forest``.  ``other_arm``: an
    arm's model for the rows of the other arm leaves out their fold too
    ("folds"), or is fitted on the whole arm ("full").  An arm with at most
    ``min_arm`` training rows gives its training mean, 0 without any (#87).
    Rows with a missing value have no nuisances."""
    from .frame import all_present
    if other_arm not in ("folds", "full"):
        raise ValueError(f"unknown other_arm {other_arm!r}")
    by, xs = list(by), list(xs)
    present = all_present([t, y, *xs])
    coefs = cut_lineage(_fold_complements(df.where(present), t, y, xs, fold, k, by, min_arm))
    d = join_on_keys(df, coefs, [*by, fold], "left")
    from .gram import linear_predictor
    ps = linear_predictor("_c_ps", xs)
    arms = {a: F.col(f"_m{a}") if learner in ("gbt", "forest") else linear_predictor(f"_c_mu{a}", xs) for a in (1, 0)}
    full = {a: F.col(f"_w{a}") if learner in ("gbt", "forest") else linear_predictor(f"_c_full{a}", xs) for a in (1, 0)}
    if learner == "logistic":
        from .logistic import logistic_fit, probability
        lc = logistic_fit(df.where(present), t, xs, by, penalty, fold, k).select(*by, F.col("fold").cast(df.schema[fold].dataType).alias(fold), F.col("coef").alias("_c_log"))
        d, ps = join_on_keys(d, lc, [*by, fold], "left"), probability("_c_log", xs)
    elif learner in ("gbt", "forest"):
        from .trees import Shape, fit_trees
        forest = learner == "forest"
        rows = df.where(present)
        t_models = {f"_p_{f}": (F.col(t), F.col(fold) != f) for f in range(k)}
        y_models = {f"_y{a}_{f}": (F.col(y), (F.col(fold) != f) & (F.col(t) == a)) for a in (1, 0) for f in range(k)}
        y_models |= {f"_w{a}": (F.col(y), F.col(t) == a) for a in (1, 0)} if other_arm == "full" else {}
        d = fit_trees(rows, xs, t_models, by, Shape(**{**(FOREST if forest else BOOSTED_PROPENSITY), "seed": seed, **params})).predict(d)
        d = fit_trees(rows, xs, y_models, by, Shape(**{**(FOREST if forest else BOOSTED_OUTCOME), "seed": seed, **params})).predict(d)
        own = {name: F.element_at(F.array(*[F.col(f"{name}_{f}") for f in range(k)]), F.col(fold).cast("int") + 1) for name in ("_p", "_y1", "_y0")}
        d = d.withColumns({"_p": own["_p"], "_m1": own["_y1"], "_m0": own["_y0"]})
        ps = F.col("_p")
    elif learner != "linear":
        raise ValueError(f"unknown learner {learner!r}")
    new = {"ps": F.when(present, ps)}
    for a in (1, 0):
        mu = F.when(F.col(f"_n{a}") > min_arm, arms[a]).otherwise(F.col(f"_mean{a}"))
        if other_arm == "full":
            mu = F.when(F.col(t) == a, mu).otherwise(F.when(F.col(f"_all{a}") > min_arm, full[a]).otherwise(F.col(f"_allmean{a}")))
        new[f"mu{a}"] = F.when(present, mu)
    d = d.withColumns(new).select(*df.columns, "ps", "mu1", "mu0")
    return d.withColumn("ps", clip_propensity("ps", *clip)) if clip else d


def _fold_complements(df: DataFrame, t: str, y: str, xs: list[str], fold: str, k: int, by: list[str], min_arm: int) -> DataFrame:
    """Per group and fold, from the sums of the other folds: the linear
    coefficients of propensity and arms, the arms' counts and means, and the
    same of the whole arms.

    One pass adds up the cross products per (group, fold, arm).  The sums of a
    training set are those of the group less the fold's, and the propensity's
    follow from the arms' (its target is 1 in one arm and 0 in the other), so
    one task per group solves all its systems."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from .gram import gram_sums, unit_diagonal
    q = len(xs) + 1
    sums = gram_sums(df.withColumn("_arm", F.col(t).cast("int")), y, xs, [*by, fold, "_arm"])
    arrays, numbers = ["_c_ps", "_c_mu1", "_c_mu0", "_c_full1", "_c_full0"], ["_n1", "_n0", "_mean1", "_mean0", "_all1", "_all0", "_allmean1", "_allmean0"]
    schema = StructType([*df.select(*by, fold).schema.fields, *[StructField(c, ArrayType(DoubleType())) for c in arrays], *[StructField(c, DoubleType()) for c in numbers]])

    def least_squares(A: np.ndarray, b: np.ndarray) -> list[float]:
        scaled, d = unit_diagonal(A)
        return (np.linalg.pinv(scaled, rcond=1e-10, hermitian=True) @ (b / d) / d).tolist()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        A, b, n = np.zeros((k, 2, q, q)), np.zeros((k, 2, q)), np.zeros((k, 2))
        for f, a, xtx, xty, count in zip(g[fold], g["_arm"], g["xtx"], g["xty"], g["n"]):
            A[int(f), int(a)] += np.asarray(xtx, float).reshape(q, q)
            b[int(f), int(a)] += np.asarray(xty, float)
            n[int(f), int(a)] += count
        whole = [A.sum(axis=0), b.sum(axis=0), n.sum(axis=0)]
        full = [least_squares(whole[0][a], whole[1][a]) for a in (0, 1)]
        means = [whole[1][a][0] / whole[2][a] if whole[2][a] else 0.0 for a in (0, 1)]
        rows = []
        for f in sorted(set(int(x) for x in g[fold])):
            At, bt, nt = whole[0] - A[f], whole[1] - b[f], whole[2] - n[f]
            mean = [bt[a][0] / nt[a] if nt[a] > 0.5 else 0.0 for a in (0, 1)]
            rows.append([*(g[c].iloc[0] for c in by), f, least_squares(At.sum(axis=0), At[1][0]), least_squares(At[1], bt[1]), least_squares(At[0], bt[0]),
                         full[1], full[0], nt[1], nt[0], mean[1], mean[0], whole[2][1], whole[2][0], means[1], means[0]])
        return pd.DataFrame(rows, columns=schema.names)

    return sums.groupBy(*by).applyInPandas(run, schema)


def linear_nuisances(df: DataFrame, t: str, y: str, xs: Sequence[str], by: Sequence[str] = (),
                     clip: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """``linear`` learner for all three nuisances at once: linear-probability
    propensity (all rows) and least-squares outcome models on the treated
    and the control rows.  The three designs' cross-product sums come from
    one grouped aggregation (arm membership as a 0/1 weight), the small sums
    table is checkpointed and solved per (group, model), and the
    coefficients join back once.  Returns ``df`` + ps, mu1, mu0."""
    from .frame import all_present
    from .gram import solve
    by, xs = list(by), list(xs)
    T = F.col(t).cast("double")
    z = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    q = len(z)
    models = {"ps": (T, F.lit(1.0)), "mu1": (F.col(y), F.when(T == 1, 1.0).otherwise(0.0)),
              "mu0": (F.col(y), F.when(T == 0, 1.0).otherwise(0.0))}
    aggs = []
    for name, (target, w) in models.items():
        aggs.append(F.sum(w).alias(f"{name}_n"))
        for i in range(q):
            for j in range(i, q):
                aggs.append(F.sum(w * z[i] * z[j]).alias(f"{name}_a_{i}_{j}"))
            aggs.append(F.sum(w * z[i] * target).alias(f"{name}_b_{i}"))
        aggs.append(F.sum(w * target * target).alias(f"{name}_yy"))
    g = cut_lineage(df.where(all_present([t, y, *xs])).groupBy(*by).agg(*aggs))
    parts = []
    for name in models:
        full = [F.col(f"{name}_a_{min(i, j)}_{max(i, j)}") for i in range(q) for j in range(q)]
        parts.append(g.select(*by, F.lit(name).alias("_model"), F.col(f"{name}_n").alias("n"),
                              F.array(*full).alias("xtx"),
                              F.array(*[F.col(f"{name}_b_{i}") for i in range(q)]).alias("xty"),
                              F.col(f"{name}_yy").alias("yty")))
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    coefs = solve(stacked, by + ["_model"])
    wide = coefs.groupBy(*by).pivot("_model", list(models)).agg(F.first("coef"))
    out = join_on_keys(df, wide.select(*by, *[F.col(m).alias(f"_c_{m}") for m in models]), by, "left")
    preds = {}
    for m in models:
        e = F.col(f"_c_{m}").getItem(0)
        for i, x in enumerate(xs):
            e = e + F.col(f"_c_{m}").getItem(i + 1) * F.col(x)
        preds[m] = e
    if clip:
        preds["ps"] = clip_propensity(preds["ps"], *clip)
    return out.withColumns(preds).drop(*[f"_c_{m}" for m in models])
