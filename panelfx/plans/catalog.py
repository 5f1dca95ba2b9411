"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes (spark, sf_dir) and returns a lazy DataFrame over
the whole input tables.  Floating outputs are rounded identically on both
sides (effects to 6 decimals) so that the oracle compare is order-free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int], default: int | None = None) -> DataFrame:
    """Round the named double columns (``default`` for the other doubles)."""
    cols = []
    for f in df.schema.fields:
        d = digits.get(f.name, default if f.dataType.typeName() in ("double", "float") else None)
        cols.append(F.round(F.col(f.name), d).alias(f.name) if d is not None else F.col(f.name))
    return df.select(*cols)


def _load_all() -> None:
    # Import modules that register queries.
    from . import queries_effects  # noqa: F401
    from . import queries_frame  # noqa: F401
    from . import queries_profile  # noqa: F401
    from . import queries_runs  # noqa: F401
    from . import queries_models  # noqa: F401
    from . import queries_io  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
