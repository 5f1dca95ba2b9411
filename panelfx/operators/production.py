"""Production-function outcome (#77-80): log inputs, the two-stage proxy
estimator and the fixed-share outcome, all per ``by`` group (imputation m).

Stage 1 regresses y on l and a cubic in (k, m).  k and m are centred and
scaled per group first: the cubic of the standardized pair spans the same
column space (with the intercept), so beta_l and the fitted values are
unchanged while the normal matrix stays well conditioned.

Stage 2 has a closed form.  Minimising sum (r - b k)^2 with
r = y - beta_l l - phi over b in [lo, hi] gives b = clip(sum k r / sum k^2).
Because k is itself a stage-1 regressor and r is the stage-1 residual,
sum k r is 0 up to rounding and b sits at the lower bound; ``at_bound``
reports that instead of presenting it as an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .frame import all_present, column_or_fallback
from .gram import linear_predictor, ols
from .learners import join_on_keys
from ..session import cut_lineage


OUTPUT, CAPITAL, LABOUR = "revenue", ("capital", "assets"), "employees"
INTERMEDIATES = ("materials", "energy", "outsourcing")
MADE = {"log_inputs": ("y", "k", "l", "m", "m_total"), "productivity_stage1": ("phi_hat", "beta_l"), "productivity_stage2": ("tfp_lp",),
        "add_outcomes": ("tfp_simple",)}


def outcome_columns() -> set[str]:
    """The columns that the outcome is made of (output, capital, labour) and all that the chain makes."""
    return {OUTPUT, *CAPITAL, LABOUR}.union(*MADE.values())


def log_inputs(df: DataFrame, output: str = OUTPUT, capital: Sequence[str] = CAPITAL, labour: str = LABOUR,
               intermediates: Sequence[str] = INTERMEDIATES) -> DataFrame:
    """y, k, l, m (and m_total).  Without intermediates m = l (then beta_l is
    not identified; stage 1 reports it)."""
    cols = df.columns
    if output not in cols:
        raise KeyError(f"{output!r} column not found")
    kcol = column_or_fallback(cols, capital)
    if labour not in cols:
        raise KeyError(f"{labour!r} column not found")
    present = [c for c in intermediates if c in cols]
    out = {"y": X.log_floor(output), "k": X.log_floor(kcol), "l": X.log_floor(labour)}
    df = df.withColumns(out)
    if present:
        total = F.greatest(X.row_sum(present), F.lit(1.0))
        return df.withColumn("m_total", total).withColumn("m", F.ln(F.col("m_total")))
    return df.withColumn("m", F.col("l"))


def polynomial_terms(cols: Sequence[str], degree: int = 3, source: dict[str, Column] | None = None
                     ) -> list[tuple[str, Column]]:
    """#77: all monomials of ``cols`` up to ``degree`` without the constant, in
    degree order (k, m, k^2, k m, m^2, k^3, ...)."""
    src = source or {c: F.col(c) for c in cols}
    terms = []
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            name = "_".join(combo)
            expr = src[combo[0]]
            for c in combo[1:]:
                expr = expr * src[c]
            terms.append((f"poly_{name}", expr))
    return terms


def of_group(df: DataFrame, one_each: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the one row of its group.  The rows stay where they are: a shuffle by a few groups would put each into one task."""
    return join_on_keys(df, F.broadcast(one_each), by, "left")


def productivity_stage1(df: DataFrame, by: Sequence[str] = (), degree: int = 3) -> tuple[DataFrame, DataFrame]:
    """#79: returns (rows + phi_hat + beta_l, coefficient table per group).

    Rows with a missing y, k, l or m get no phi_hat (scatter back by ``when``)."""
    by = list(by)
    ok = all_present(["y", "k", "l", "m"])
    stats = df.where(ok).groupBy(*by).agg(
        F.avg("k").alias("_km"), F.stddev_pop("k").alias("_ks"), F.avg("m").alias("_mm"), F.stddev_pop("m").alias("_ms"))
    z = of_group(df, stats, by)
    safe = lambda s: F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(1.0))
    src = {"k": (F.col("k") - F.col("_km")) / safe("_ks"), "m": (F.col("m") - F.col("_mm")) / safe("_ms")}
    terms = polynomial_terms(["k", "m"], degree, src)
    z = z.withColumns({n: e for n, e in terms})
    names = [n for n, _ in terms]
    coefs = ols(z, "y", ["l", *names], by)
    fitted = of_group(z, coefs.select(*by, F.col("coef").alias("_coef")), by).withColumn("_fit", linear_predictor("_coef", ["l", *names])).drop("_coef")
    beta = coefs.select(*by, F.col("coef").getItem(1).alias("beta_l"), F.col("identified").alias("stage1_identified"),
                        F.col("r2").alias("stage1_r2"))
    out = of_group(fitted, beta, by)
    out = out.withColumn("phi_hat", F.when(ok, F.col("_fit") - F.col("beta_l") * F.col("l")))
    out = out.withColumn("beta_l", F.when(ok, F.col("beta_l")))
    return out.drop("_fit", "_km", "_ks", "_mm", "_ms", *names), beta


def productivity_stage2(df: DataFrame, by: Sequence[str] = (), lo: float = 0.01, hi: float = 0.99
                        ) -> tuple[DataFrame, DataFrame]:
    """#80: closed-form bounded stage 2 and tfp_lp = y - beta_l l - beta_k k."""
    by = list(by)
    ok = all_present(["y", "k", "l", "phi_hat"])
    r = F.col("y") - F.col("beta_l") * F.col("l") - F.col("phi_hat")
    est = df.where(ok).groupBy(*by).agg(F.sum(F.col("k") * r).alias("skr"), F.sum(F.col("k") * F.col("k")).alias("skk"),
                                        F.max("beta_l").alias("_bl"))
    raw = F.try_divide(F.col("skr"), F.col("skk"))
    est = est.select(*by, raw.alias("beta_k_unbounded"), F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)).alias("beta_k"),
                     "_bl")
    est = est.withColumn("at_bound", (F.col("beta_k") <= lo) | (F.col("beta_k") >= hi))
    rows = of_group(df, est.select(*by, "beta_k", F.col("_bl").alias("_beta_l_g")), by)
    rows = rows.withColumn("tfp_lp", F.col("y") - F.col("_beta_l_g") * F.col("l") - F.col("beta_k") * F.col("k"))
    return rows.drop("_beta_l_g"), est.drop("_bl")


def add_outcomes(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Full chain: log inputs, stage 1, stage 2, fixed-share outcome.

    The chain creates columns y, k, l, m (log of the intermediate inputs).
    When the groups' key is itself called ``m`` (imputations), that name
    stays with the key and the inputs come out as ``m_log``."""
    if "m" in by:
        rows, est = add_outcomes(df.withColumnRenamed("m", "_imputation"), ["_imputation" if c == "m" else c for c in by])
        return (rows.withColumnsRenamed({"m": "m_log"}).withColumnRenamed("_imputation", "m"),
                est.withColumnRenamed("_imputation", "m"))
    # The inputs feed the scaling statistics, the normal equations and the
    # fitted values; the stage-1 rows feed the stage-2 sums and the final
    # rows.  Both are materialised once instead of being rebuilt each time.
    d = cut_lineage(log_inputs(df))
    d, beta = productivity_stage1(d, by)
    d = cut_lineage(d)
    d, est = productivity_stage2(d, by)
    d = d.withColumn("tfp_simple", X.fixed_share_outcome("y", "k", "l"))
    return d, join_on_keys(beta, est, list(by), "inner")
