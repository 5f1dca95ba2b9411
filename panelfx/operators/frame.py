"""Row/column operators: filters, projections, listwise deletion, gates and
key-based alignment (#13-22, #69-70).  Column-list logic runs on the driver
against ``df.columns`` (schema only, no data); everything else is a lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a single-row aggregate (a global statistic) to
    every row.  The right side is one row by construction (an ``agg``
    without keys), so broadcasting it is size-safe; no pairs are formed."""
    return df.crossJoin(F.broadcast(one))


def filter_sector(df: DataFrame, col: str, value) -> DataFrame:
    """#13: keep rows whose sector column equals ``value``; an absent column
    returns the input unchanged.  ``sector_share`` gives the kept share."""
    if col not in df.columns:
        return df
    return df.where(F.col(col) == F.lit(value))


def sector_share(df: DataFrame, col: str, value) -> DataFrame:
    """Total rows, kept rows and kept percent of ``filter_sector`` (one agg)."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count(F.when(F.col(col) == F.lit(value), 1)).alias("n_kept"),
                  (F.lit(100.0) * F.count(F.when(F.col(col) == F.lit(value), 1)) / F.count(F.lit(1)))
                  .alias("kept_pct"))


@dataclass
class Selection:
    mapping: dict[str, str]                      # alias -> source, as applied
    requested: list[str]                         # aliases after dedupe
    missing: list[tuple[str, str]] = field(default_factory=list)   # (alias, source) absent


def plan_selection(columns: Sequence[str], alias_map: Mapping[str, str]) -> Selection:
    """#14 driver-side list logic: the first alias of a source wins; keep only
    sources present in ``columns``; report the absent ones."""
    seen: set[str] = set()
    dedup: dict[str, str] = {}
    for alias, src in alias_map.items():
        if src not in seen:
            dedup[alias] = src
            seen.add(src)
    present = set(columns)
    found = {a: s for a, s in dedup.items() if s in present}
    missing = [(a, s) for a, s in dedup.items() if s not in present]
    return Selection(found, list(dedup), missing)


def select_and_rename(df: DataFrame, alias_map: Mapping[str, str]) -> tuple[DataFrame, Selection]:
    sel = plan_selection(df.columns, alias_map)
    return df.select(*[F.col(s).alias(a) for a, s in sel.mapping.items()]), sel


def covariate_columns(columns: Sequence[str], exclude: Sequence[str] = (),
                      selected: Sequence[str] | None = None, skip_prefix: str | None = None) -> list[str]:
    """#15: all columns minus ``exclude``; restricted to ``selected`` when
    given; names starting with ``skip_prefix`` dropped."""
    ex = set(exclude)
    out = [c for c in columns if c not in ex]
    if selected is not None:
        keep = set(selected)
        out = [c for c in out if c in keep]
    if skip_prefix:
        out = [c for c in out if not c.startswith(skip_prefix)]
    return out


class CovariateCountError(ValueError):
    pass


def check_covariates(covariates: Sequence[str], expected: int | None = None) -> list[str]:
    """#16: raise when fewer than ``expected``; return a warning list when more."""
    if expected is None:
        return []
    if len(covariates) < expected:
        raise CovariateCountError(f"{len(covariates)} covariates, expected {expected}")
    if len(covariates) != expected:
        return [f"{len(covariates)} covariates, expected {expected}"]
    return []


def drop_missing_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """#17: listwise deletion over the given columns."""
    return df.na.drop(how="any", subset=list(cols))


def all_present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def complete_cases(df: DataFrame, cols: Sequence[str], min_rows: int = 100,
                   by: Sequence[str] = (), min_per_arm: int = 0, treatment: str | None = None) -> DataFrame:
    """#18: rows with all ``cols`` present; groups (``by``) with fewer than
    ``min_rows`` complete rows (or fewer than ``min_per_arm`` per treatment
    arm) are dropped, which yields a missing estimate downstream."""
    cc = df.where(all_present(cols))
    return group_size_gate(cc, by, min_rows, treatment=treatment, min_per_arm=min_per_arm)


def group_size_gate(df: DataFrame, by: Sequence[str], min_rows: int, treatment: str | None = None,
                    min_treated: int = 0, min_per_arm: int = 0) -> DataFrame:
    """#20: keep groups with at least ``min_rows`` rows (and ``min_treated``
    treated / ``min_per_arm`` in each arm).  The per-group counts are a
    partial aggregation; the gate is a left-semi join on the group key."""
    by = list(by)
    conds = [F.count(F.lit(1)) >= min_rows]
    if treatment and min_treated:
        conds.append(F.sum(F.col(treatment).cast("long")) >= min_treated)
    if treatment and min_per_arm:
        conds.append(F.sum(F.col(treatment).cast("long")) >= min_per_arm)
        conds.append(F.sum(1 - F.col(treatment).cast("long")) >= min_per_arm)
    cond = reduce(lambda a, b: a & b, conds)
    if not by:
        # One-row gate: a join with an aggregate of zero or one row.
        ok = df.agg(cond.alias("_ok")).where("_ok").drop("_ok")
        return with_one_row(df, ok)
    keep = df.groupBy(*by).agg(cond.alias("_ok")).where("_ok").select(*by)
    return df.join(keep, by, "left_semi")


def column_or_fallback(columns: Sequence[str], candidates: Sequence[str], required: bool = True) -> str | None:
    """#21: first candidate present in ``columns``; none -> raise (or None)."""
    for c in candidates:
        if c in columns:
            return c
    if required:
        raise KeyError(f"none of {list(candidates)} present")
    return None


def scatter_back(df: DataFrame, cols: Sequence[str], name: str, expr: Column) -> DataFrame:
    """#22: a value defined on the complete subset only; other rows stay missing
    (a ``when`` on the same rows, no join)."""
    return df.withColumn(name, F.when(all_present(cols), expr))


def attach_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """#69: put column blocks of the same rows side by side by key."""
    return left.join(right, list(keys), how)


def align_with_fill(df: DataFrame, subset: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """#70: membership of ``subset`` as a flag, false elsewhere.

    ``subset`` is reduced to distinct keys first, so the left join never
    multiplies rows."""
    marks = subset.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """#2 / #61: stack tables by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
