"""Normal and Student-t distribution functions (scipy is not available).

Used on pooled estimate rows only (one row per method or group), through
Arrow-batched pandas UDFs; the per-row hot path uses the column-expression
normal approximation in ``expr``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NORMAL_DF = 1e6   # above this many degrees of freedom the t is the normal


def norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF by bisection on erf (monotone; 1e-12 tolerance)."""
    if not 0.0 < p < 1.0:
        return math.copysign(math.inf, p - 0.5) if p in (0.0, 1.0) else math.nan
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if norm_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13:
            break
    return 0.5 * (lo + hi)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Value of 1 / (1 + d1 / (1 + d2 / (1 + ...))) for the incomplete beta
    function (DLMF 8.17.22), evaluated from the last term inwards:

      d(2k)   =  k (b - k) x / ((a + 2k - 1)(a + 2k))
      d(2k+1) = -(a + k)(a + b + k) x / ((a + 2k)(a + 2k + 1))

    The terms needed grow with the root of the larger parameter."""
    terms = 100 + 6 * math.isqrt(int(max(a, b)) + 1)
    value = 1.0
    for k in range(terms, -1, -1):
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = 1.0 + odd / value
        if k:
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            value = 1.0 + even / value
    return 1.0 / value


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * beta_fraction(a, b, x) / a
    return 1.0 - math.exp(lbt) * beta_fraction(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float | None) -> float:
    if df is None or (isinstance(df, float) and (math.isnan(df) or math.isinf(df))) or df > NORMAL_DF:
        return norm_cdf(t)
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return 1.0 - tail if t > 0 else tail


def t_ppf(p: float, df: float | None) -> float:
    if df is None or (isinstance(df, float) and (math.isnan(df) or math.isinf(df))) or df > NORMAL_DF:
        return norm_ppf(p)
    lo, hi = -1e3, 1e3
    for _ in range(300):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-12:
            break
    return 0.5 * (lo + hi)


def _nullable(v) -> float | None:
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


@F.pandas_udf(DoubleType())
def t_crit_975(df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf(0.975, _nullable(d)) for d in df], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = []
    for tv, dv in zip(t, df):
        if tv is None or (isinstance(tv, float) and math.isnan(tv)):
            out.append(np.nan)
        else:
            out.append(2.0 * (1.0 - t_cdf(abs(float(tv)), _nullable(dv))))
    return pd.Series(out, dtype="float64")


def t_columns(est: Column, se: Column, df: Column) -> dict[str, Column]:
    """CI, t statistic and p with Student-t quantiles (normal when df is
    missing or huge)."""
    crit = t_crit_975(df)
    t = F.try_divide(est, se)
    return {"ci_lower": est - crit * se, "ci_upper": est + crit * se, "t_stat": t, "p_value": t_two_sided_p(t, df)}
