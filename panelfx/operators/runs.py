"""Run-result tables: metrics, summaries, pivots, merge/dedup, grids (#19,
#56-68).

A run table has one row per (condition, seed, method) with the estimate
columns of FIXTURES.md §3.  Everything is grouped aggregation or a keyed
join; ordering for keep-first/keep-last comes from explicit ``file_no`` /
``line_no`` columns (never from physical row order).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .frame import with_one_row

CONDITION_KEYS = ("n", "p", "imbalance_ratio", "missing_rate", "scenario")
RUN_KEYS = CONDITION_KEYS + ("seed", "method")
SUMMARY_KEYS = ("imbalance_ratio", "missing_rate", "method")


def run_metrics(df: DataFrame, est: str = "ate_est", truth: str = "true_ate", lo: str = "ci_lower",
                hi: str = "ci_upper") -> DataFrame:
    """#56: bias, squared error, coverage (0 when the CI is missing), width."""
    e, t = F.col(est), F.col(truth)
    return df.withColumns({
        "bias": e - t,
        "squared_error": (e - t) * (e - t),
        "coverage": F.coalesce(((F.col(lo) <= t) & (t <= F.col(hi))).cast("int"), F.lit(0)),
        "ci_width": F.col(hi) - F.col(lo),
    })


def clean_runs(df: DataFrame, error: str = "error") -> DataFrame:
    """#19: rows without an error."""
    return df.where(F.col(error).isNull())


def clean_run_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """#19 report: total, clean, clean percent, errors."""
    return (df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(error).isNull()).alias("clean"))
            .withColumn("clean_pct", F.lit(100.0) * F.col("clean") / F.col("total"))
            .withColumn("errors", F.col("total") - F.col("clean")))


def run_summary(df: DataFrame, keys: Sequence[str] = SUMMARY_KEYS, digits: int | None = 3,
                rmse_from_rounded: bool = False) -> DataFrame:
    """#57: per group mean and std (n-1) of bias, mean squared error, mean
    coverage and runtime, rounded; rmse = sqrt(mse) (unrounded mse by
    default, the rounded one with ``rmse_from_rounded``).  Add ``scenario``
    to ``keys`` to keep scenarios apart."""
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    out = df.groupBy(*keys).agg(
        rnd(F.avg("bias")).alias("bias_mean"), rnd(F.stddev_samp("bias")).alias("bias_std"),
        F.avg("squared_error").alias("_mse"), rnd(F.avg("coverage")).alias("coverage"),
        rnd(F.avg("runtime")).alias("runtime"), F.count(F.lit(1)).alias("n_runs"))
    mse = rnd(F.col("_mse"))
    rmse = F.sqrt(mse) if rmse_from_rounded else F.sqrt(F.col("_mse"))
    return out.withColumn("mse", mse).withColumn("rmse", rmse).drop("_mse")


def rmse_approx(df: DataFrame, keys: Sequence[str] = SUMMARY_KEYS, est: str = "ate_est") -> DataFrame:
    """#58: sqrt(mean bias^2 + std(estimate)^2) per group."""
    return (df.groupBy(*keys).agg(F.avg("bias").alias("bias_mean"), F.stddev_samp(est).alias("ate_std"))
            .withColumn("rmse_approx", F.sqrt(F.col("bias_mean") ** 2 + F.col("ate_std") ** 2)))


def pivot_by_method(summary: DataFrame, value: str, methods: Sequence[str],
                    keys: Sequence[str] = ("imbalance_ratio", "missing_rate"), method: str = "method") -> DataFrame:
    """#59: one column per method (explicit pivot values: no extra job to
    discover them, stable schema)."""
    return summary.groupBy(*keys).pivot(method, list(methods)).agg(F.first(value))


def compare_to_baseline(df: DataFrame, method: str, ref_bias: float, ref_coverage: float,
                        method_col: str = "method") -> DataFrame:
    """#60: one method's mean bias and coverage against reference values."""
    return (df.where(F.col(method_col) == method)
            .agg(F.avg("bias").alias("bias_mean"), F.avg("coverage").alias("coverage_mean"))
            .withColumn("bias_multiple", F.try_divide(F.abs(F.col("bias_mean")), F.lit(ref_bias)))
            .withColumn("coverage_drop", F.lit(ref_coverage) - F.col("coverage_mean")))


def count_duplicates(df: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """#62: number of rows that sit in key groups larger than one (all key
    columns must exist, else there is nothing to count)."""
    if any(k not in df.columns for k in keys):
        return df.sparkSession.range(1).select(F.lit(None).cast("long").alias("n_duplicate_rows"))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("long")
                 .alias("n_duplicate_rows"))


def merge_runs(df: DataFrame, strategy: str = "keep_first", keys: Sequence[str] = RUN_KEYS,
               order: Sequence[str] = ("file_no", "line_no")) -> DataFrame:
    """#63: de-duplicate stacked run tables.

    ``keep_first`` / ``keep_last`` keep the row with the smallest / largest
    (file_no, line_no) per key; ``average`` groups by the keys (rows with a missing
    key dropped, as a grouped mean does) and averages numeric non-key
    columns; a table without duplicate keys comes back unchanged.  Unknown strategies mean ``keep_first``; missing key columns
    return the input unchanged."""
    keys = list(keys)
    if any(k not in df.columns for k in keys):
        return df
    if strategy == "average":
        if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").isEmpty():
            return df
        num = [f.name for f in df.schema.fields
               if isinstance(f.dataType, NumericType) and f.name not in keys and f.name not in order]
        if not num:
            strategy = "keep_first"
        else:
            present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            return df.where(present).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in num])
    # First/last per key as an aggregate (min_by/max_by over the ordering
    # struct): map-side partial aggregation, so a key with a huge number of
    # copies never lands whole in one task, unlike a window.
    pick = F.max_by if strategy == "keep_last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return got.select(*keys, "_row.*").select(*df.columns)


def check_grid_consistency(df: DataFrame, file_col: str = "file_no",
                           keys: Sequence[str] = CONDITION_KEYS) -> DataFrame:
    """#64: per file, the distinct parameter rows compared (as sets) with those
    of the first file: missing and extra counts and a consistent flag.

    Set sizes come from a semi join against the first file's grid, so no
    file x condition product is formed."""
    keys = list(keys)
    grid = df.select(file_col, *keys).distinct()
    first = df.agg(F.min(file_col).alias("_f"))
    ref = grid.join(first, grid[file_col] == first["_f"], "left_semi").drop(file_col)
    n_ref = ref.agg(F.count(F.lit(1)).alias("_n_ref"))
    common = grid.join(ref, keys, "left_semi").groupBy(file_col).agg(F.count(F.lit(1)).alias("_common"))
    counts = grid.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_conditions"))
    out = counts.join(common, file_col, "left").fillna(0, ["_common"])
    out = with_one_row(out, n_ref)
    out = (out.withColumn("n_missing", F.col("_n_ref") - F.col("_common"))
           .withColumn("n_extra", F.col("n_conditions") - F.col("_common")).drop("_common", "_n_ref"))
    return out.withColumn("consistent", ((F.col("n_missing") == 0) & (F.col("n_extra") == 0)).cast("int"))


def merged_statistics(df: DataFrame, keys: Sequence[str] = CONDITION_KEYS) -> DataFrame:
    """#65: one-row statistics of a merged run table."""
    reps = df.groupBy(*keys).agg(F.count_distinct("seed").alias("r"))
    rep_stats = reps.agg(F.count(F.lit(1)).alias("n_conditions"), F.min("r").alias("min_replications"),
                         F.max("r").alias("max_replications"), F.avg("r").alias("mean_replications"))
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("method").alias("n_methods"),
                  F.count("error").alias("n_errors"),
                  (F.count("error") / F.count(F.lit(1))).alias("error_rate"),
                  F.avg("ate_est").alias("ate_mean"), F.stddev_samp("ate_est").alias("ate_std"),
                  F.min("ate_est").alias("ate_min"), F.max("ate_est").alias("ate_max"))
    return with_one_row(base, rep_stats)


def parameter_grid(*lists: DataFrame) -> DataFrame:
    """#66: product of parameter lists (each a small one-column DataFrame of
    distinct values).  The product is the operator's definition; its size
    is the grid size (product of the list lengths), independent of the
    data volume."""
    return reduce(lambda a, b: a.crossJoin(b), lists)


def completed_conditions(runs: DataFrame, grid: DataFrame, n_min: int,
                         keys: Sequence[str] | None = None, seed: str = "seed") -> DataFrame:
    """#67: grid rows with at least ``n_min`` distinct seeds in the run table."""
    keys = list(keys or grid.columns)
    done = runs.groupBy(*keys).agg(F.count_distinct(seed).alias("n_seeds")).where(F.col("n_seeds") >= n_min)
    return grid.join(done, keys, "inner")


def pending_conditions(runs: DataFrame, grid: DataFrame, n_min: int,
                       keys: Sequence[str] | None = None, seed: str = "seed") -> DataFrame:
    """#68: grid rows still to run (anti join with the completed ones)."""
    keys = list(keys or grid.columns)
    done = completed_conditions(runs, grid, n_min, keys, seed).select(*keys)
    return grid.join(done, keys, "left_anti")
