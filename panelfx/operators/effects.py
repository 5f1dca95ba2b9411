"""Treatment-effect estimators.  Every estimator takes ``by=[...]`` and
returns one row per group, so loops over imputations, folds, replicates,
periods or industries are grouping keys, not driver loops.

Estimate columns: n, n_treated, treated_pct, ate, se, ci_lower, ci_upper,
z, p_value, effect_pct (ate, se in the outcome's unit; effect_pct for a log
outcome).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import normal_ci, normal_two_sided_p, percent_effect, clip_propensity
from ..session import cut_lineage
from .frame import all_present
from .learners import _cell_predictions, cell_moments, cell_nuisances, join_on_keys, nuisances


def aipw_score(t: str = "t", y: str = "y", ps: str = "ps", mu1: str = "mu1", mu0: str = "mu0") -> Column:
    """psi = T(Y-mu1)/ps + mu1 - (1-T)(Y-mu0)/(1-ps) - mu0.

    ps in {0, 1} gives NULL (try_divide) instead of an error or infinity."""
    T, Y = F.col(t).cast("double"), F.col(y)
    return (F.try_divide(T * (Y - F.col(mu1)), F.col(ps)) + F.col(mu1)
            - F.try_divide((F.lit(1.0) - T) * (Y - F.col(mu0)), F.lit(1.0) - F.col(ps)) - F.col(mu0))


def finish_estimate(df: DataFrame, by: Sequence[str] = (), z_crit: float = 1.96) -> DataFrame:
    """Add ci, z, p and percent columns to a table with ate, se (and n, n_treated)."""
    lo, hi = normal_ci("ate", "se", z_crit)
    z = F.try_divide(F.col("ate"), F.col("se"))
    out = df.withColumn("ci_lower", lo).withColumn("ci_upper", hi).withColumn("z", z)
    return (out.withColumn("p_value", normal_two_sided_p("z"))
            .withColumn("effect_pct", percent_effect("ate")))


def summarize_scores(df: DataFrame, score: str = "psi", by: Sequence[str] = (), t: str | None = "t",
                     ddof: int = 0, min_rows: int = 0, y: str | None = None) -> DataFrame:
    """ate = mean(score), se = sqrt(var/n) with var_pop (ddof=0) or var_samp.

    ``n_dropped``: rows with treatment and outcome that have no score."""
    var = F.var_pop(score) if ddof == 0 else F.var_samp(score)
    present = all_present([c for c in (t, y) if c])
    aggs = [F.count(score).alias("n"), F.count_if(F.col(score).isNull() & present).alias("n_dropped")]
    if t:
        aggs.append(F.sum(F.when(F.col(score).isNotNull(), F.col(t).cast("long"))).alias("n_treated"))
    aggs += [F.avg(score).alias("ate"), F.sqrt(F.try_divide(var, F.count(score))).alias("se")]
    res = df.groupBy(*by).agg(*aggs)
    if min_rows:
        res = res.where(F.col("n") >= min_rows)
    if t:
        res = res.withColumn("treated_pct", F.lit(100.0) * F.col("n_treated") / F.col("n"))
    return finish_estimate(res, by)


def aipw_effect(df: DataFrame, t: str = "t", y: str = "y", ps: str = "ps", mu1: str = "mu1",
                mu0: str = "mu0", by: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """#88 on a scored table (any learner)."""
    scored = df.withColumn("psi", aipw_score(t, y, ps, mu1, mu0))
    return summarize_scores(scored, "psi", by, t, 0, min_rows, y)


def aipw_influence(df: DataFrame, t: str = "t", y: str = "y", ps: str = "ps", mu1: str = "mu1",
                   mu0: str = "mu0", by: Sequence[str] = ()) -> DataFrame:
    """Row-level influence values psi - ate (the group mean joins back by key)."""
    scored = df.withColumn("psi", aipw_score(t, y, ps, mu1, mu0))
    means = scored.groupBy(*by).agg(F.avg("psi").alias("_ate"))
    joined = join_on_keys(scored, means, by, "left")
    return joined.withColumn("influence", F.col("psi") - F.col("_ate")).drop("_ate")


def affine_score_stats(tab: DataFrame, by: Sequence[str], ddof: int = 0, min_rows: int = 0) -> DataFrame:
    """Mean and standard error of a per-row score that is affine in Y within
    each row of ``tab``: score = alpha_a + beta_a Y for arm a.  ``tab`` holds
    per (group, cell[, fold]) the arm moments n{a}, ybar{a}, m2_{a} and the
    coefficients alpha{a}, beta{a}.  Sum and squared deviations of the score
    follow exactly (parallel variance formula), so rows are never revisited."""
    by = list(by)
    # One rule, as in ``aipw_score``: where the propensity is 0 or 1 no row of the cell has a score.
    scored = F.col("alpha1").isNotNull() & F.col("beta1").isNotNull() & F.col("alpha0").isNotNull() & F.col("beta0").isNotNull()
    tab = tab.withColumns({"_all": F.col("n1") + F.col("n0"), "n1": F.when(scored, F.col("n1")).otherwise(F.lit(0)),
                           "n0": F.when(scored, F.col("n0")).otherwise(F.lit(0))})
    arms = tab.select(*by, F.col("n1"), F.col("n0"), "_all",
                      F.when(F.col("n1") > 0, F.col("alpha1") + F.col("beta1") * F.col("ybar1")).alias("p1"),
                      F.when(F.col("n0") > 0, F.col("alpha0") + F.col("beta0") * F.col("ybar0")).alias("p0"),
                      F.when(scored, F.col("beta1") * F.col("beta1") * F.coalesce(F.col("m2_1"), F.lit(0.0))).alias("w1"),
                      F.when(scored, F.col("beta0") * F.col("beta0") * F.coalesce(F.col("m2_0"), F.lit(0.0))).alias("w0"))
    grp = arms.groupBy(*by).agg(
        (F.sum("n1") + F.sum("n0")).alias("n"), F.sum("n1").alias("n_treated"),
        (F.sum("_all") - F.sum("n1") - F.sum("n0")).alias("n_dropped"),
        F.try_divide(F.sum(F.coalesce(F.col("n1") * F.col("p1"), F.lit(0.0)))
                     + F.sum(F.coalesce(F.col("n0") * F.col("p0"), F.lit(0.0))),
                     F.sum("n1") + F.sum("n0")).alias("ate"))
    if min_rows:
        grp = grp.where(F.col("n") >= min_rows)
    both = join_on_keys(arms, grp, by, "inner")
    dev = both.groupBy(*by).agg(
        (F.sum(F.coalesce(F.col("w1") + F.col("w0"), F.lit(0.0))
               + F.coalesce(F.col("n1") * (F.col("p1") - F.col("ate")) ** 2, F.lit(0.0))
               + F.coalesce(F.col("n0") * (F.col("p0") - F.col("ate")) ** 2, F.lit(0.0)))).alias("_ss"))
    res = join_on_keys(grp, dev, by, "inner")
    var = F.try_divide(F.col("_ss"), F.col("n") - F.lit(ddof))
    res = (res.withColumn("se", F.try_divide(F.sqrt(var), F.sqrt(F.col("n")))).drop("_ss")
           .withColumn("treated_pct", F.try_divide(F.lit(100.0) * F.col("n_treated"), F.col("n"))))
    return res


def cell_aipw(df: DataFrame, t: str, y: str, cells: Sequence[str], by: Sequence[str] = (),
              clip: tuple[float, float] | None = (0.01, 0.99), min_rows: int = 0,
              min_train: int = 0) -> DataFrame:
    """AIPW with cell-mean nuisances from cell moments alone (one scan).

    With ps, mu1, mu0 constant in a cell, psi is affine in Y within each
    (cell, arm): psi = alpha + beta Y.  Sum and sum of squared deviations of
    psi per group follow from the per-arm count, mean and M2 of Y, so the
    rows are read once (the per-cell table is checkpointed, all later steps
    read that small table) and never joined back.  Equal to ``aipw_effect``
    after ``cell_nuisances`` up to float rounding.
    """
    by, cells = list(by), list(cells)
    # The moments table (one row per cell) feeds several small aggregations
    # and joins; materialising it once keeps the input to a single scan.
    return aipw_from_moments(cut_lineage(cell_moments(df, t, y, cells, by)), cells, by, clip, min_rows, min_train)


def aipw_from_moments(cell: DataFrame, cells: Sequence[str], by: Sequence[str] = (),
                      clip: tuple[float, float] | None = (0.01, 0.99), min_rows: int = 0, min_train: int = 0) -> DataFrame:
    """AIPW from a stored table of cell moments (``learners.cell_moments``)."""
    by = list(by)
    tab = _cell_predictions(cell, by, cells, clip, min_train)
    ps, mu1, mu0 = F.col("ps"), F.col("mu1"), F.col("mu0")
    tab = tab.withColumns({
        "beta1": F.try_divide(F.lit(1.0), ps), "alpha1": mu1 - F.try_divide(mu1, ps) - mu0,
        "beta0": F.try_divide(F.lit(-1.0), F.lit(1.0) - ps),
        "alpha0": mu1 + F.try_divide(mu0, F.lit(1.0) - ps) - mu0})
    return finish_estimate(affine_score_stats(tab, by, 0, min_rows), by)


def cell_tmle(df: DataFrame, t: str, y: str, cells: Sequence[str], by: Sequence[str] = (),
              clip: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """#90 with cell-mean nuisances in one scan.  Nuisances come unclipped
    from the cell moments, g is clipped for targeting.  eps per group is a
    ratio of cell sums (sum H (Y - Q) = n1 (ybar1 - mu1)/g - n0 (ybar0 - mu0)/(1-g),
    sum H^2 = n1/g^2 + n0/(1-g)^2); the targeted score is again affine in Y
    per (cell, arm).  Equal to ``tmle_effect`` on the row plan."""
    by, cells = list(by), list(cells)
    cell = cut_lineage(cell_moments(df, t, y, cells, by))
    tab = _cell_predictions(cell, by, cells, None, 0)
    g = clip_propensity("ps", *clip) if clip else F.col("ps")
    tab = tab.withColumn("_g", g)
    n1 = F.col("n1").cast("double")
    n0 = F.col("n0").cast("double")
    num = (F.coalesce(n1 * (F.col("ybar1") - F.col("mu1")), F.lit(0.0)) / F.col("_g")
           - F.coalesce(n0 * (F.col("ybar0") - F.col("mu0")), F.lit(0.0)) / (F.lit(1.0) - F.col("_g")))
    den = n1 / (F.col("_g") * F.col("_g")) + n0 / ((F.lit(1.0) - F.col("_g")) ** 2)
    eps = tab.groupBy(*by).agg(F.try_divide(F.sum(num), F.sum(den)).alias("epsilon"))
    tab = join_on_keys(tab, eps, by, "inner")
    m1s = F.col("mu1") + F.col("epsilon") / F.col("_g")
    m0s = F.col("mu0") - F.col("epsilon") / (F.lit(1.0) - F.col("_g"))
    tab = tab.withColumn("_m1s", m1s).withColumn("_m0s", m0s)
    tab = tab.withColumns({
        "beta1": F.lit(1.0) / F.col("_g"), "alpha1": F.col("_m1s") - F.col("_m1s") / F.col("_g") - F.col("_m0s"),
        "beta0": F.lit(-1.0) / (F.lit(1.0) - F.col("_g")),
        "alpha0": F.col("_m1s") + F.col("_m0s") / (F.lit(1.0) - F.col("_g")) - F.col("_m0s")})
    stats = affine_score_stats(tab, by)
    # The estimate is the mean of mu1* - mu0* (cell-size weighted), which
    # differs from the mean score by the targeted residual term.
    est = tab.groupBy(*by).agg(F.try_divide(F.sum((n1 + n0) * (F.col("_m1s") - F.col("_m0s"))),
                                            F.sum(n1 + n0)).alias("_ate"), F.first("epsilon").alias("epsilon"))
    res = join_on_keys(stats, est, by, "inner").withColumn("ate", F.col("_ate")).drop("_ate")
    return finish_estimate(res, by)


def cell_aipw_rows(df: DataFrame, t: str, y: str, cells: Sequence[str], by: Sequence[str] = (),
                   clip: tuple[float, float] | None = (0.01, 0.99), min_rows: int = 0) -> DataFrame:
    """Row-level plan of the same estimate: nuisances joined back, psi, aggregate."""
    scored = cell_nuisances(df, t, y, cells, by, clip)
    return aipw_effect(scored, t, y, "ps", "mu1", "mu0", by, min_rows)


ESTIMATE_COLUMNS = ["n", "n_treated", "treated_pct", "ate", "se", "ci_lower", "ci_upper", "z",
                    "p_value", "effect_pct"]


def tmle_effect(df: DataFrame, t: str = "t", y: str = "y", ps: str = "ps", mu1: str = "mu1", mu0: str = "mu0",
                by: Sequence[str] = (), clip: tuple[float, float] | None = (0.01, 0.99)) -> DataFrame:
    """#90 on a scored table (any learner): one-step targeting.

    g clipped; H = T/g - (1-T)/(1-g); eps = sum H (Y - Q) / sum H^2 per group;
    mu1* = mu1 + eps/g, mu0* = mu0 - eps/(1-g); ate = mean(mu1* - mu0*); se
    from the influence curve with the population variance.  The curve is
    A + eps B with A = H (Y - Q) + mu1 - mu0 and B = 1/g + 1/(1-g) - H^2, so
    eps, ate and variance follow from moments of one aggregation.  Rows
    without a score are left out.  ``score_sum`` is sum H (Y - Q*)."""
    g = clip_propensity(ps, *clip) if clip else F.col(ps)
    T, Y = F.col(t).cast("double"), F.col(y)
    d = df.select(*by, T.alias("_T"), g.alias("_g"), (F.col(mu1) - F.col(mu0)).alias("_D"),
                  (Y - (T * F.col(mu1) + (F.lit(1.0) - T) * F.col(mu0))).alias("_r"))
    one = F.lit(1.0)
    d = d.withColumns({"_H": F.try_divide(F.col("_T"), F.col("_g")) - F.try_divide(one - F.col("_T"), one - F.col("_g")),
                       "_C": F.try_divide(one, F.col("_g")) + F.try_divide(one, one - F.col("_g"))}).where("_r is not null and _H is not null and _C is not null")
    d = d.withColumns({"_A": F.col("_H") * F.col("_r") + F.col("_D"), "_B": F.col("_C") - F.col("_H") * F.col("_H")})
    res = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_T").cast("long")).alias("n_treated"),
        F.sum(F.col("_H") * F.col("_r")).alias("_hr"), F.sum(F.col("_H") * F.col("_H")).alias("_hh"), F.avg("_D").alias("_d"), F.avg("_C").alias("_c"),
        F.var_pop("_A").alias("_va"), F.var_pop("_B").alias("_vb"), F.covar_pop("_A", "_B").alias("_vab"))
    eps = F.col("epsilon")
    res = res.withColumn("epsilon", F.try_divide(F.col("_hr"), F.col("_hh")))
    var = F.greatest(F.col("_va") + 2 * eps * F.col("_vab") + eps * eps * F.col("_vb"), F.lit(0.0))
    res = res.withColumns({"ate": F.col("_d") + eps * F.col("_c"), "se": F.sqrt(var / F.col("n")), "score_sum": F.col("_hr") - eps * F.col("_hh"),
                           "treated_pct": F.lit(100.0) * F.col("n_treated") / F.col("n")})
    return finish_estimate(res.drop("_hr", "_hh", "_d", "_c", "_va", "_vb", "_vab"), by)


def tmle(df: DataFrame, t: str, y: str, xs: Sequence[str], learner: str = "cell", by: Sequence[str] = (),
         clip: tuple[float, float] | None = (0.01, 0.99), **params) -> DataFrame:
    """#90: nuisances by any learner (propensity unclipped), then targeting.  ``cell`` needs no second scan."""
    if learner == "cell":
        return cell_tmle(df, t, y, xs, by, clip)
    return tmle_effect(nuisances(df, t, y, xs, learner, by, None, **params), t, y, "ps", "mu1", "mu0", by, clip)


def aipw(df: DataFrame, t: str, y: str, xs: Sequence[str], learner: str = "cell", by: Sequence[str] = (),
         clip: tuple[float, float] | None = (0.01, 0.99), min_rows: int = 0, **params) -> DataFrame:
    """#88: nuisances by any learner, then the AIPW estimate."""
    if learner == "cell":
        return cell_aipw(df, t, y, xs, by, clip, min_rows)
    return aipw_effect(nuisances(df, t, y, xs, learner, by, clip, **params), t, y, by=by, min_rows=min_rows)


def pool_rubin(est: DataFrame, by: Sequence[str] = (), ate: str = "ate", se: str = "se",
               reference: str = "t", single_b_zero: bool = True) -> DataFrame:
    """#91: Rubin's rules over the imputations of each group.

    qbar = mean ate; W = mean se^2; B = var_samp(ate) (0 when M = 1);
    total = W + (1 + 1/M) B; df = (M-1)(1 + W/((1+1/M)B))^2 (NULL when B = 0).
    ``reference="t"``: Student-t interval and p (normal when df is NULL or
    above 1e6); ``"z"``: 1.96 and the normal p."""
    by = list(by)
    M = F.count(F.lit(1))
    g = est.groupBy(*by).agg(M.alias("M"), F.avg(ate).alias("ate"), F.avg(F.col(se) * F.col(se)).alias("W"),
                             F.var_samp(ate).alias("B"))
    if single_b_zero:
        g = g.withColumn("B", F.coalesce(F.col("B"), F.lit(0.0)))
    infl = F.lit(1.0) + F.lit(1.0) / F.col("M")
    g = g.withColumn("total_var", F.col("W") + infl * F.col("B")).withColumn("se", F.sqrt("total_var"))
    g = g.withColumn("df", F.when(F.col("B") > 0, (F.col("M") - 1) * (
        F.lit(1.0) + F.col("W") / (infl * F.col("B"))) ** 2))
    if reference == "z":
        lo, hi = normal_ci("ate", "se")
        z = F.try_divide(F.col("ate"), F.col("se"))
        return (g.withColumn("ci_lower", lo).withColumn("ci_upper", hi).withColumn("t_stat", z)
                .withColumn("p_value", normal_two_sided_p(z)).withColumn("effect_pct", percent_effect("ate")))
    from ..functions.stats import t_columns
    return g.withColumns(t_columns(F.col("ate"), F.col("se"), F.col("df"))).withColumn(
        "effect_pct", percent_effect("ate"))
