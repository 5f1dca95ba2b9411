"""Profiling aggregations (#42-55).

Each profile is one aggregation pass (map-side partial aggregates, one
small shuffle); per-column results are turned into rows with ``unpivot`` on
the one-row aggregate, never by looping over columns with separate jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import all_present, with_one_row
from .learners import join_on_keys
from .quantiles import exact_percentiles


def _unpivot_one_row(row_df: DataFrame, names: Sequence[str], prefix_map: dict[str, str],
                     var_col: str = "variable") -> DataFrame:
    """One-row aggregate with columns ``<stat>__<name>`` -> one row per name."""
    structs = [F.struct(F.lit(n).alias(var_col),
                        *[F.col(f"{p}__{n}").alias(out) for p, out in prefix_map.items()])
               for n in names]
    return row_df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def missing_summary(df: DataFrame, cols: Sequence[str], top: int | None = 10) -> DataFrame:
    """#42: missing count and percent (1 decimal) per column, descending,
    ties by name, first ``top``."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(c).isNull()).alias(f"m__{c}") for c in cols]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("variable"), F.col(f"m__{c}").alias("missing"),
                        F.round(F.lit(100.0) * F.col(f"m__{c}") / F.col("_n"), 1).alias("percent"))
               for c in cols]
    out = one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
    out = out.orderBy(F.desc("missing"), F.asc("variable"))
    return out.limit(top) if top else out


def complete_case_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """#43: rows with no missing among ``cols``, percent and loss."""
    ok = all_present(cols)
    return (df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("complete"))
            .withColumn("complete_pct", F.lit(100.0) * F.col("complete") / F.col("n"))
            .withColumn("loss_pct", F.lit(100.0) - F.col("complete_pct")))


def code_distribution(raw: DataFrame, recoded_exprs: dict, cols: Sequence[str]) -> DataFrame:
    """#44: per code column, answered / missing before and 0 / >0 after the
    recode.  ``recoded_exprs`` maps a column to its recoded expression, so
    before and after come from the same scan."""
    aggs = []
    for c in cols:
        after = recoded_exprs[c]
        aggs += [F.count(F.col(c)).alias(f"answered__{c}"), F.count_if(F.col(c).isNull()).alias(f"missing__{c}"),
                 F.count_if(after == 0).alias(f"zero__{c}"), F.count_if(after > 0).alias(f"positive__{c}")]
    one = raw.agg(*aggs)
    return _unpivot_one_row(one, cols, {"answered": "answered", "missing": "missing_before",
                                        "zero": "zero_after", "positive": "positive_after"})


def recode_audit(raw: DataFrame, recoded_exprs: dict, cols: Sequence[str], cutoff: int,
                 year: str = "year") -> DataFrame:
    """#45: per year and code column: missing recoded to 0, ones recoded to 0
    (new wave only), zeros after the recode."""
    y = F.col(year)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"na__{c}"),
                 F.count_if((y > cutoff) & (F.col(c) == 1)).alias(f"one__{c}"),
                 F.count_if(recoded_exprs[c] == 0).alias(f"zero__{c}")]
    per_year = raw.groupBy(year).agg(*aggs)
    structs = [F.struct(F.lit(c).alias("variable"), F.col(f"na__{c}").alias("na_recoded"),
                        F.col(f"one__{c}").alias("ones_recoded"), F.col(f"zero__{c}").alias("zeros_after"))
               for c in cols]
    return (per_year.select(year, "n", F.explode(F.array(*structs)).alias("_s"))
            .select(year, "n", "_s.*"))


def treatment_by_group(df: DataFrame, t: str, by: Sequence[str]) -> DataFrame:
    """#46: treated, total and percent per group."""
    return (df.groupBy(*by).agg(F.sum(F.col(t).cast("long")).alias("treated"), F.count(F.lit(1)).alias("total"))
            .withColumn("treated_pct", F.lit(100.0) * F.col("treated") / F.col("total")))


def describe_numeric(df: DataFrame, cols: Sequence[str], ddof: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """#47: mean, exact median, min, max, std (n-1 or n) and valid count per
    column, one row per column (and group)."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean__{c}"), F.min(c).alias(f"min__{c}"),
                 F.max(c).alias(f"max__{c}"), std(c).alias(f"std__{c}"), F.count(c).alias(f"n__{c}")]
    medians = exact_percentiles(df, cols, [0.5], by)
    medians = medians.select(*by, *[F.element_at(c, 1).alias(f"median__{c}") for c in cols])
    one = join_on_keys(df.groupBy(*by).agg(*aggs), medians, by, "left")
    structs = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{s}__{c}").alias(s) for s in
                                                       ("mean", "median", "min", "max", "std")],
                        F.col(f"n__{c}").alias("n_valid")) for c in cols]
    return one.select(*by, F.explode(F.array(*structs)).alias("_s")).select(*by, "_s.*")


DEFAULT_PERCENTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)


def percentile_profile(df: DataFrame, col: str, ps: Sequence[float] = DEFAULT_PERCENTILES,
                       by: Sequence[str] = ()) -> DataFrame:
    """#48: exact percentiles with linear interpolation."""
    one = exact_percentiles(df, [col], ps, by).withColumnRenamed(col, "_p")
    return one.select(*by, *[F.col("_p").getItem(i).alias(f"p{int(round(p * 100))}") for i, p in enumerate(ps)])


def treatment_balance(df: DataFrame, t: str, covariates: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """#49: treated / control counts and shares, covariate count."""
    tc = F.col(t).cast("long")
    return (df.groupBy(*by).agg(F.sum(tc).alias("n_treated"), F.sum(1 - tc).alias("n_control"),
                                F.count(F.lit(1)).alias("n"))
            .withColumn("treated_share", F.col("n_treated") / F.col("n"))
            .withColumn("control_share", F.col("n_control") / F.col("n"))
            .withColumn("n_covariates", F.lit(len(covariates))))


DUMMY_NAME_HINTS = ("industry", "region", "year")


def bounded_distinct(df: DataFrame, cols: Sequence[str], most: int) -> DataFrame:
    """One row: per column its number of distinct present values, ``most`` + 1 if there are more.

    A task keeps up to ``most`` + 1 values per column and sends these; one
    scan, and no row is copied per column."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set[str]] = [set() for _ in cols]
        for batch in batches:
            for held, column in zip(seen, batch.columns):
                if len(held) <= most:
                    held.update(v for v in column.unique().slice(0, 2 * most + 2 + len(held)).to_pylist() if v is not None)
        rows = [(i, v) for i, held in enumerate(seen) for v in sorted(held)[:most + 1]]
        if rows:
            at, values = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values, pa.string())], ["at", "value"])

    values = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "at int, value string")
    counts = values.distinct()
    return counts.agg(*[F.least(F.count_if(F.col("at") == i), F.lit(most + 1)).alias(f"d__{c}") for i, c in enumerate(cols)])


def exact_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: per column its number of distinct present values, however many.

    One scan; a task sends the distinct values of each batch, and equal ones
    meet in a shuffle by column and value."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, column in enumerate(batch.columns):
                values = column.unique().drop_null()
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), values], ["at", "value"])

    def text(c: str) -> Column:
        # -0.0 and 0.0 are one value.
        value = F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
        return value.cast("string")

    values = df.select(*[text(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "at int, value string")
    return values.distinct().agg(*[F.count_if(F.col("at") == i).alias(f"d__{c}") for i, c in enumerate(cols)])


def dummy_columns(df: DataFrame, cols: Sequence[str], max_distinct: int = 10, share: float = 0.3, count_all: bool = False) -> DataFrame:
    """#50: columns named like industry/region/year or with at most
    ``max_distinct`` distinct values; with their overall share and whether it
    passes ``share``.  ``n_distinct`` is exact up to ``max_distinct`` and
    ``max_distinct`` + 1 beyond; with ``count_all`` it is exact throughout."""
    one = exact_distinct(df, cols) if count_all else bounded_distinct(df, cols, max_distinct)
    rows = _unpivot_one_row(one, cols, {"d": "n_distinct"})
    name_hint = None
    for h in DUMMY_NAME_HINTS:
        cond = F.lower(F.col("variable")).contains(h)
        name_hint = cond if name_hint is None else (name_hint | cond)
    rows = rows.withColumn("is_dummy", (name_hint | (F.col("n_distinct") <= max_distinct)).cast("int"))
    # ``rows`` has one row per column name, so this second aggregate is tiny.
    tot = rows.agg((F.sum("is_dummy") / F.lit(float(len(cols)))).alias("dummy_share"))
    return (with_one_row(rows, tot)
            .withColumn("mostly_dummies", (F.col("dummy_share") > share).cast("int")))


def propensity_diagnostics(df: DataFrame, ps: str = "ps", t: str = "t", lo: float = 0.01,
                           hi: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """#51: range, mean, std (population) of ps; common support =
    [max of arm minima, min of arm maxima] and the share inside; count and
    share of extreme scores.  Two aggregations over the rows, joined on the
    (tiny) group key."""
    by = list(by)
    p, tr = F.col(ps), F.col(t)
    first = df.groupBy(*by).agg(
        F.count(p).alias("n"), F.min(p).alias("ps_min"), F.max(p).alias("ps_max"), F.avg(p).alias("ps_mean"),
        F.stddev_pop(p).alias("ps_std"),
        F.greatest(F.min(F.when(tr == 1, p)), F.min(F.when(tr == 0, p))).alias("support_lo"),
        F.least(F.max(F.when(tr == 1, p)), F.max(F.when(tr == 0, p))).alias("support_hi"),
        F.count_if(p < lo).alias("n_below"), F.count_if(p > hi).alias("n_above"))
    joined = df.join(first.select(*by, "support_lo", "support_hi"), by, "inner") if by else \
        with_one_row(df, first.select("support_lo", "support_hi"))
    inside = joined.groupBy(*by).agg(
        F.avg(((p >= F.col("support_lo")) & (p <= F.col("support_hi"))).cast("double")).alias("share_in_support"))
    res = first.join(inside, by, "inner") if by else with_one_row(first, inside)
    return (res.withColumn("share_below", F.col("n_below") / F.col("n"))
            .withColumn("share_above", F.col("n_above") / F.col("n")))


def clever_covariate_diagnostics(df: DataFrame, t: str = "t", ps: str = "ps", mu1: str = "mu1",
                                 mu0: str = "mu0", by: Sequence[str] = ()) -> DataFrame:
    """#52: mean/std of mu1, mu0, ps; mean and max of T/g and (1-T)/(1-g)."""
    T, g = F.col(t).cast("double"), F.col(ps)
    h1, h0 = T / g, (F.lit(1.0) - T) / (F.lit(1.0) - g)
    aggs = []
    for c in (mu1, mu0, ps):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    aggs += [F.avg(h1).alias("h1_mean"), F.max(h1).alias("h1_max"), F.avg(h0).alias("h0_mean"), F.max(h0).alias("h0_max")]
    return df.groupBy(*by).agg(*aggs)


def outcome_model_summary(df: DataFrame, mu1: str = "mu1", mu0: str = "mu0", by: Sequence[str] = ()) -> DataFrame:
    """#53."""
    aggs = []
    for c in (mu1, mu0):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def outcome_correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """#54: Pearson correlation and the two means (pairwise complete rows)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).groupBy(*by).agg(F.corr(a, b).alias("correlation"), F.avg(a).alias(f"{a}_mean"),
                                           F.avg(b).alias(f"{b}_mean"), F.count(F.lit(1)).alias("n"))


def value_counts_top_k(df: DataFrame, key: str, k: int = 5, min_rows: int = 500) -> DataFrame:
    """#55: groups with at least ``min_rows`` rows, by count descending (key as
    tie-break), first ``k``; ``n_groups`` is the number of qualifying groups.
    The top-k is the feature here: the limit applies to group rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    n_groups = counts.agg(F.count(F.lit(1)).alias("n_groups"))
    top = counts.orderBy(F.desc("n"), F.asc(key)).limit(k)
    return with_one_row(top, n_groups)
