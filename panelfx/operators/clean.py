"""Cleaning and feature steps of the panel (#23-31) as one projection.

All steps are column expressions over the same rows, so the whole chain
from scan to engineered table is a single narrow stage (no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import expr as X

# The binary Y/N survey columns.
BINARY_YN_COLUMNS = ("production_outsourcing_domestic", "rd_outsourcing_domestic",
                     "corporate_group_restricted", "stock_market_listing", "has_subsidiaries")

# Engineered ratios as (name, numerator, denominator).
RATIO_FEATURES = (
    ("debt_to_equity", "total_debt", "total_equity"),
    ("current_ratio", "quick_assets", "current_liabilities"),
    ("asset_turnover", "revenue", "total_assets"),
    ("patent_intensity", "patents_held", "employees"),
    ("rd_employee_ratio", "rd_employees_total", "employees"),
    ("export_intensity", "direct_export_amount", "revenue"),
    ("import_intensity", "direct_import_amount", "revenue"),
    ("female_employee_ratio", "regular_employees_female", "employees"),
    ("production_worker_ratio", "hq_production_employees_total", "hq_employees_total"),
)

CODE_COLUMNS = ("dti_iot", "dti_cloud", "dti_ai", "dti_bigdata")
KEY_COLUMNS = ("firm_id", "year")
TREATMENT_MEAN, TREATMENT = "dti_mean", "dti_binary"


def treatment_columns() -> set[str]:
    """The columns that the treatment is made of and those it is put into."""
    return {*CODE_COLUMNS, TREATMENT_MEAN, TREATMENT}


def binary_recode(df: DataFrame, cols: Sequence[str] = BINARY_YN_COLUMNS) -> DataFrame:
    """#23 on the named columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: X.yes_no_to_binary(c) for c in present}) if present else df


def coerce_numeric(df: DataFrame, id_cols: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """#24: every non-id column to double; text through the strict parser,
    NaN to NULL."""
    out = {}
    for f in df.schema.fields:
        if f.name in id_cols:
            continue
        if isinstance(f.dataType, StringType):
            out[f.name] = X.to_numeric(f.name)
        elif isinstance(f.dataType, NumericType):
            out[f.name] = X.nan_to_null(F.col(f.name).cast("double"))
        else:
            out[f.name] = F.lit(None).cast("double")
    return df.withColumns(out)


def recode_codes(df: DataFrame, cutoff: int, cols: Sequence[str] = CODE_COLUMNS, year: str = "year") -> DataFrame:
    """#25 on the code columns that exist."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: X.recode_wave_codes(c, year, cutoff).cast("double") for c in present})


def ratio_features(df: DataFrame, spec=RATIO_FEATURES) -> tuple[DataFrame, list[str]]:
    """#28: each ratio only if both inputs exist.  Returns the table and the
    names created."""
    made = {name: X.safe_ratio(num, den) for name, num, den in spec
            if num in df.columns and den in df.columns}
    return (df.withColumns(made) if made else df), list(made)


def recomputed_ratios(df: DataFrame, spec=RATIO_FEATURES) -> DataFrame:
    """#28 with ``recompute_ratios``: ratios made before an imputation are made anew from the completed components.

    Only ratios that the table has and whose inputs exist change."""
    return ratio_features(df, [r for r in spec if r[0] in df.columns])[0]


def feature_audit(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """#28b: one row per engineered column: whether the table has it, and its mean."""
    have = [n for n in names if n in df.columns]
    one = df.agg(*[F.avg(n).alias(n) for n in have]) if have else df.agg(F.count(F.lit(1)).alias("_n"))
    rows = [F.struct(F.lit(n).alias("feature"), F.lit(int(n in have)).alias("present"),
                     (F.col(n) if n in have else F.lit(None)).cast("double").alias("mean")) for n in names]
    return one.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


def add_period_dummies(df: DataFrame, years: Sequence[int], covid_from: int | None,
                       year: str = "year") -> DataFrame:
    """#29."""
    return df.withColumns(X.period_dummies(year, years, covid_from))


def add_treatment(df: DataFrame, cols: Sequence[str] = CODE_COLUMNS, mean_col: str = TREATMENT_MEAN,
                  out: str = TREATMENT, threshold: float = 0.0, offset: float = 0.0,
                  min_cols: int = 2) -> DataFrame:
    """#26 + #27: row mean of the code columns and its binary version."""
    present = [c for c in cols if c in df.columns]
    if len(present) < min_cols:
        raise ValueError(f"need at least {min_cols} code columns, found {present}")
    return (df.withColumn(mean_col, X.row_mean(present))
            .withColumn(out, X.binarize_treatment(mean_col, threshold, offset)))
