"""Scalar column expressions (JVM-side, whole-stage codegen friendly).

Every function returns a ``Column``; nothing here runs Python per row.
Missing-value rules follow the analysis conventions: NaN is folded into
NULL at ingest, a floor/clip never turns a missing value into a number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- coercion

# Plain decimal / scientific notation only.  Spark's cast also accepts forms
# such as '1d', '2f' or hex floats, which a numeric parser of survey text
# must reject.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nan_to_null(x: ColumnOrName) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c), c)


def to_numeric(x: ColumnOrName) -> Column:
    """#24: parse text to double, anything unparsable becomes NULL."""
    c = _c(x).cast("string")
    return F.when(c.rlike(NUMERIC_PATTERN), F.trim(c).try_cast("double"))


def yes_no_to_binary(x: ColumnOrName, yes: str = "Y") -> Column:
    """#23: 'Y' -> 1, any other present value -> 0, missing stays missing."""
    c = _c(x)
    return F.when(c == yes, F.lit(1)).when(c.isNotNull(), F.lit(0))


def recode_wave_codes(code: ColumnOrName, year: ColumnOrName, cutoff: int) -> Column:
    """#25: wave-dependent code recode.

    Years up to ``cutoff``: missing -> 0, codes kept.  Later years: code 1
    means "not adopted" and becomes 0, missing -> 0, other codes kept.
    """
    c, y = _c(code), _c(year)
    return (F.when((y > cutoff) & (c == 1), F.lit(0))
            .otherwise(F.coalesce(c, F.lit(0))))


# ------------------------------------------------------------- row helpers

def row_sum(cols: Sequence[ColumnOrName]) -> Column:
    """Sum over present values; all missing gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0.0)) for c in cols])


def row_count_present(cols: Sequence[ColumnOrName]) -> Column:
    return reduce(lambda a, b: a + b, [_c(c).isNotNull().cast("int") for c in cols])


def row_mean(cols: Sequence[ColumnOrName]) -> Column:
    """#26: mean over present values of a row (missing if none present)."""
    n = row_count_present(cols)
    return F.when(n > 0, row_sum(cols) / n)


def binarize_treatment(mean: ColumnOrName, threshold: float = 0.0, offset: float = 0.0) -> Column:
    """#27: 1 if (mean - offset) > threshold, else 0; a missing mean gives 0."""
    return F.coalesce(_c(mean) - F.lit(offset) > F.lit(threshold), F.lit(False)).cast("int")


# ------------------------------------------------------------ feature math

RATIO_EPS = 1e-6


def safe_ratio(num: ColumnOrName, den: ColumnOrName, eps: float = RATIO_EPS) -> Column:
    """x / (y + eps); a zero denominator gives NULL instead of an error."""
    return F.try_divide(_c(num), _c(den) + F.lit(eps))


def log_floor(x: ColumnOrName, floor: float = 1.0) -> Column:
    """#30: ln(max(x, floor)); missing stays missing (greatest() would not)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(float(floor)))))


def log_row_sum(cols: Sequence[ColumnOrName], floor: float = 1.0) -> Column:
    """#31: sum present columns (missing as 0), floor, ln."""
    return F.ln(F.greatest(row_sum(cols), F.lit(float(floor))))


def fixed_share_outcome(y: ColumnOrName, k: ColumnOrName, l: ColumnOrName,
                        alpha: float = 0.3, beta: float = 0.7) -> Column:
    """#32: y - alpha k - beta l."""
    return _c(y) - F.lit(alpha) * _c(k) - F.lit(beta) * _c(l)


def clip(x: ColumnOrName, lo: float | None, hi: float | None) -> Column:
    """Clip that keeps NULL as NULL."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def clip_propensity(ps: ColumnOrName, lo: float = 0.01, hi: float = 0.99) -> Column:
    """#33."""
    return clip(ps, lo, hi)


# --------------------------------------------------------- inference math

def percent_effect(ate: ColumnOrName) -> Column:
    """#34: 100 (exp(ate) - 1)."""
    return F.lit(100.0) * (F.exp(_c(ate)) - F.lit(1.0))


def normal_ci(est: ColumnOrName, se: ColumnOrName, z: float = 1.96) -> tuple[Column, Column]:
    """#35."""
    return _c(est) - F.lit(z) * _c(se), _c(est) + F.lit(z) * _c(se)


# Abramowitz & Stegun 7.1.26 rational approximation of erf
# (|error| <= 1.5e-7).  p, a1, a2, a3, a4, a5 in this order.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_two_sided_p(z: ColumnOrName) -> Column:
    """#36: 2 (1 - Phi(|z|)) as a column expression.

    With x = |z|/sqrt(2): 2(1 - Phi(|z|)) = 1 - erf(x) = poly(t) exp(-x^2).
    """
    az = F.abs(_c(z))
    x = az / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = reduce(lambda acc, a: acc * t + F.lit(a), reversed(AS_A[:-1]), F.lit(AS_A[-1])) * t
    return poly * F.exp(-(x * x))


def p_value_reference_form(z: ColumnOrName) -> Column:
    """#37: 2(1 - .5(1 + sign(z)(1 - exp(-z^2/2)))), kept for comparison only.

    Equals exp(-z^2/2) for z > 0 and 2 - exp(-z^2/2) for z < 0.
    """
    zc = _c(z)
    return F.lit(2.0) * (F.lit(1.0) - F.lit(0.5) * (
        F.lit(1.0) + F.signum(zc) * (F.lit(1.0) - F.exp(-(zc * zc) / F.lit(2.0)))))


def significance_stars(p: ColumnOrName) -> Column:
    """#38."""
    pc = _c(p)
    return (F.when(pc < 0.001, F.lit("***")).when(pc < 0.01, F.lit("**"))
            .when(pc < 0.05, F.lit("*")).otherwise(F.lit("")))


# The three period labels and their years.
PERIOD_LABELS = ("Pre-COVID (2019)", "During-COVID (2020-2021)", "Post-COVID (2022-2023)")
PERIOD_YEARS = ((2019,), (2020, 2021), (2022, 2023))


def period_label(year: ColumnOrName, labels: Sequence[str] = PERIOD_LABELS,
                 years: Sequence[Sequence[int]] = PERIOD_YEARS) -> Column:
    """#39: years of the 2nd/3rd group get their label, every other year the first."""
    y = _c(year)
    out = F.lit(labels[0])
    for lab, ys in reversed(list(zip(labels[1:], years[1:]))):
        out = F.when(y.isin(list(ys)), F.lit(lab)).otherwise(out)
    return out


def period_dummies(year: ColumnOrName, years: Sequence[int], covid_from: int | None = None,
                   prefix: str = "year_") -> dict[str, Column]:
    """#29: one 0/1 column per year, plus ``covid_period`` = year >= covid_from."""
    y = _c(year)
    out = {f"{prefix}{v}": (y == v).cast("int") for v in years}
    if covid_from is not None:
        out["covid_period"] = (y >= covid_from).cast("int")
    return out


HASH_RANGE = 1 << 52


def hash_int(*parts: ColumnOrName, method: str = "md5") -> Column:
    """Deterministic 52-bit integer of the parts.

    ``md5``: first 13 hex digits of md5 of the parts joined by ':' (the same
    integer in every engine, which the SQL oracles rely on).  ``xxhash``:
    xxhash64 of the parts modulo 2^52 (much cheaper, Spark-only)."""
    if method == "xxhash":
        return F.pmod(F.xxhash64(*[_c(p) for p in parts]), F.lit(HASH_RANGE).cast("long"))
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_uniform(*parts: ColumnOrName, method: str = "md5") -> Column:
    """Deterministic draw from the open interval (0, 1) by ``hash_int``; never
    0 or 1, stable on recompute (unlike rand())."""
    return (hash_int(*parts, method=method).cast("double") + F.lit(0.5)) / F.lit(float(HASH_RANGE))
