"""Quantile binning (#40, #41) with exact, interpolated percentiles.

Edges are one grouped aggregate (a row per group), joined back on the group
key, so the binning itself is a narrow projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import with_one_row
from .learners import join_on_keys
from .quantiles import exact_percentiles


def attach_edges(df: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges of each row's group; a NULL group key is a group like others."""
    return join_on_keys(df, edges, by, "left") if by else with_one_row(df, edges)


def edge_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """One row per group: per column ``_e_<column>``, the distinct edges in rising order."""
    found = exact_percentiles(df, cols, probs, by)
    return found.select(*by, *[F.array_distinct(c).alias(f"_e_{c}") for c in cols])


def quantile_bucket(df: DataFrame, col: str, q: int, labels: Sequence[str] | None = None,
                    by: Sequence[str] = (), out: str = "bucket") -> DataFrame:
    """#40 (``qcut`` semantics): edges at k/q quantiles, duplicate edges
    dropped, right-closed bins with the lowest edge included.  When labels
    are given and the number of bins after dropping differs, the query fails
    (``raise_error``) as a label/bin mismatch."""
    probs = [i / q for i in range(q + 1)]
    edges = edge_table(df, [col], probs, by).withColumnRenamed(f"_e_{col}", "_e")
    x, e = F.col(col), F.col("_e")
    n = F.size(e)
    idx = F.lit(None).cast("int")
    # bin index = number of edges strictly below x (first edge inclusive)
    below = sum(F.coalesce((x > F.try_element_at(e, F.lit(i + 1))).cast("int"), F.lit(0)) for i in range(q + 1))
    idx = F.when(x.isNull() | (x < F.element_at(e, 1)) | (x > F.element_at(e, -1)), idx).otherwise(
        F.greatest(below, F.lit(1)) - 1)
    res = attach_edges(df, edges, by)
    if labels is not None:
        lab = F.array(*[F.lit(s) for s in labels])
        check = F.when(n - 1 != len(labels), F.raise_error(F.lit(
            "bin edges must be one more than the number of labels"))).otherwise(F.lit(None).cast("string"))
        res = res.withColumn(out, F.coalesce(check, F.element_at(lab, idx + 1)))
    else:
        res = res.withColumn(out, idx)
    return res.drop("_e")


def coarsen(df: DataFrame, cols: Sequence[str], n_bins: int = 5, by: Sequence[str] = (),
            suffix: str = "_bin") -> DataFrame:
    """#41: per column, quantile edges at 0..100 %, unique, and the bin =
    number of inner edges <= x (``digitize`` on the inner edges)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    res = attach_edges(df, edge_table(df, cols, probs, by), by)
    new = {}
    for c in cols:
        e = F.col(f"_e_{c}")
        inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
        new[c + suffix] = F.when(F.col(c).isNotNull(), F.aggregate(
            inner, F.lit(0), lambda acc, v: acc + (F.col(c) >= v).cast("int")))
    return res.withColumns(new).drop(*[f"_e_{c}" for c in cols])
