"""The cleaned firm panel: fixture -> select/rename -> Y/N recode -> numeric
coercion -> wave recode -> ratios -> period dummies -> treatment.

One lazy plan with no shuffle after the fixture's own aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import NUMERIC_PATTERN
from ..operators import clean as C
from ..operators.frame import filter_sector, select_and_rename
from .panel import CODE_WAVE_CUTOFF, firm_panel

# Alias -> source column of the fixture.  ``total_assets`` repeats the
# source of ``capital`` (first alias wins) and ``total_equity`` has no
# source, so both show up in the selection report.
FIXTURE_ALIASES = {
    "firm_id": "firm_id", "year": "year", "industry_2digit": "industry_2digit", "region": "region",
    "dti_iot": "dti_iot", "dti_cloud": "dti_cloud", "dti_ai": "dti_ai", "dti_bigdata": "dti_bigdata",
    "revenue": "revenue", "employees": "employees", "capital": "capital", "total_assets": "capital",
    "materials": "materials", "energy": "energy", "total_debt": "debt", "total_equity": "equity",
    "rd_employees_total": "rd_employees", "direct_export_amount": "exports_txt",
    "has_subsidiaries": "has_subsidiaries",
}
DUMMY_YEARS = (1998, 1999, 2000, 2001)
COVID_FROM = 1998


def clean_firm_panel(spark: SparkSession, sf_dir: str, sector: str | None = None,
                     with_treatment: bool = True) -> DataFrame:
    raw = firm_panel(spark, sf_dir)
    if sector is not None:
        raw = filter_sector(raw, "sector", sector)
    df, _ = select_and_rename(raw, FIXTURE_ALIASES)
    df = C.binary_recode(df)
    df = C.coerce_numeric(df)
    df = C.recode_codes(df, CODE_WAVE_CUTOFF)
    df, _ = C.ratio_features(df)
    df = C.add_period_dummies(df, DUMMY_YEARS, COVID_FROM)
    if with_treatment:
        df = C.add_treatment(df)
    return df


def _num(c: str) -> str:
    pat = NUMERIC_PATTERN.replace("'", "''")
    return f"case when regexp_matches({c}, '{pat}') then try_cast(trim({c}) as double) end"


def _recode(c: str) -> str:
    return f"cast(case when year > {CODE_WAVE_CUTOFF} and {c} = 1 then 0 else coalesce({c}, 0) end as double)"


# SQL of the same table; expects a CTE named ``panel`` (the fixture).
CLEAN_SQL = f"""
clean0 as (
  select firm_id, year, cast(industry_2digit as double) industry_2digit, cast(region as double) region,
    {_recode('dti_iot')} dti_iot, {_recode('dti_cloud')} dti_cloud, {_recode('dti_ai')} dti_ai,
    {_recode('dti_bigdata')} dti_bigdata,
    cast(revenue as double) revenue, cast(employees as double) employees, cast(capital as double) capital,
    cast(materials as double) materials, cast(energy as double) energy, cast(debt as double) total_debt,
    cast(rd_employees as double) rd_employees_total, {_num('exports_txt')} direct_export_amount,
    cast(case when has_subsidiaries = 'Y' then 1 when has_subsidiaries is not null then 0 end as double) has_subsidiaries
  from panel),
clean as (
  select *, rd_employees_total / (employees + 1e-6) rd_employee_ratio,
    direct_export_amount / (revenue + 1e-6) export_intensity,
    {', '.join(f'cast(year = {y} as integer) year_{y}' for y in DUMMY_YEARS)},
    cast(year >= {COVID_FROM} as integer) covid_period,
    (dti_iot + dti_cloud + dti_ai + dti_bigdata) / 4.0 dti_mean,
    cast((dti_iot + dti_cloud + dti_ai + dti_bigdata) / 4.0 > 0 as integer) dti_binary
  from clean0)"""
