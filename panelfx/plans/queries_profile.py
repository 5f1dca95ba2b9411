"""Profiling queries (#42-55)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import profile as PR
from ..operators.learners import cell_nuisances
from . import sqlfrag as S
from .catalog import register, rounded
from .firm import CLEAN_SQL, clean_firm_panel
from .panel import CODE_COLUMNS, CODE_WAVE_CUTOFF, firm_panel, order_panel, read_table


def P(final: str, extra: str = "") -> str:
    ctes = CLEAN_SQL.strip() + ("," + extra if extra else "")
    return S.with_panel(ctes, final)


_MISS_COLS = ["industry_2digit", "region", "revenue", "employees", "capital", "materials", "energy", "total_debt",
              "rd_employees_total", "direct_export_amount", "has_subsidiaries", "rd_employee_ratio",
              "export_intensity"]


@register("missing_summary", P("""
select variable, missing, percent from (
  select variable, missing, round(100.0 * missing / n, 1) percent from (
    """ + " union all ".join(f"select '{c}' variable, (count(*) - count({c}))::bigint missing, count(*) n from clean"
                             for c in _MISS_COLS) + """) u
) v order by missing desc, variable limit 10"""))
def q_missing_summary(spark, sf_dir):
    return PR.missing_summary(clean_firm_panel(spark, sf_dir), _MISS_COLS, top=10)


@register("complete_case_rate", P("""
select count(*)::bigint n, count(case when total_debt is not null and rd_employees_total is not null
  and direct_export_amount is not null and has_subsidiaries is not null then 1 end)::bigint complete,
  round(100.0 * count(case when total_debt is not null and rd_employees_total is not null
  and direct_export_amount is not null and has_subsidiaries is not null then 1 end) / count(*), 4) complete_pct,
  round(100.0 - 100.0 * count(case when total_debt is not null and rd_employees_total is not null
  and direct_export_amount is not null and has_subsidiaries is not null then 1 end) / count(*), 4) loss_pct
from clean"""))
def q_complete_case_rate(spark, sf_dir):
    res = PR.complete_case_rate(clean_firm_panel(spark, sf_dir),
                                ["total_debt", "rd_employees_total", "direct_export_amount", "has_subsidiaries"])
    return rounded(res, {"complete_pct": 4, "loss_pct": 4})


def _recoded_exprs():
    return {c: X.recode_wave_codes(c, "year", CODE_WAVE_CUTOFF) for c in CODE_COLUMNS}


def _rec_sql(c):
    return f"(case when year > {CODE_WAVE_CUTOFF} and {c} = 1 then 0 else coalesce({c}, 0) end)"


@register("code_distribution", S.with_panel("", " union all ".join(
    f"select '{c}' variable, count({c})::bigint answered, (count(*) - count({c}))::bigint missing_before, "
    f"count(case when {_rec_sql(c)} = 0 then 1 end)::bigint zero_after, "
    f"count(case when {_rec_sql(c)} > 0 then 1 end)::bigint positive_after from panel" for c in CODE_COLUMNS)))
def q_code_distribution(spark, sf_dir):
    return PR.code_distribution(firm_panel(spark, sf_dir), _recoded_exprs(), CODE_COLUMNS)


@register("recode_audit", S.with_panel("", " union all ".join(
    f"select year, count(*)::bigint n, '{c}' variable, (count(*) - count({c}))::bigint na_recoded, "
    f"count(case when year > {CODE_WAVE_CUTOFF} and {c} = 1 then 1 end)::bigint ones_recoded, "
    f"count(case when {_rec_sql(c)} = 0 then 1 end)::bigint zeros_after from panel group by year"
    for c in CODE_COLUMNS)))
def q_recode_audit(spark, sf_dir):
    return PR.recode_audit(firm_panel(spark, sf_dir), _recoded_exprs(), CODE_COLUMNS, CODE_WAVE_CUTOFF)


@register("treatment_by_group", P("""
select year, sum(dti_binary)::bigint treated, count(*)::bigint total,
  round(100.0 * sum(dti_binary) / count(*), 4) treated_pct from clean group by year"""))
def q_treatment_by_group(spark, sf_dir):
    res = PR.treatment_by_group(clean_firm_panel(spark, sf_dir), "dti_binary", ["year"])
    return rounded(res, {"treated_pct": 4})


_DESC = ["revenue", "employees", "total_debt"]


@register("describe_numeric", P(" union all ".join(
    f"select '{c}' variable, round(avg({c}), 4) mean, round(median({c}), 4) median, round(min({c}), 4) min, "
    f"round(max({c}), 4) max, round(stddev_samp({c}), 4) std, count({c})::bigint n_valid from clean"
    for c in _DESC)))
def q_describe_numeric(spark, sf_dir):
    res = PR.describe_numeric(clean_firm_panel(spark, sf_dir), _DESC, ddof=1)
    return rounded(res, {}, default=4)


@register("percentile_profile", """
select event_type, """ + ", ".join(
    f"round(quantile_cont(value, {p}), 6) p{int(round(p * 100))}" for p in PR.DEFAULT_PERCENTILES) + """
from events group by event_type""")
def q_percentile_profile(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(PR.percentile_profile(ev, "value", by=["event_type"]), {}, default=6)


@register("treatment_balance", P("""
select sum(dti_binary)::bigint n_treated, sum(1 - dti_binary)::bigint n_control, count(*)::bigint n,
  round(sum(dti_binary) / count(*), 6) treated_share, round(sum(1 - dti_binary) / count(*), 6) control_share,
  15 n_covariates from clean"""))
def q_treatment_balance(spark, sf_dir):
    from .queries_frame import covariates_of
    df = clean_firm_panel(spark, sf_dir)
    res = PR.treatment_balance(df, "dti_binary", covariates_of(df.columns))
    return rounded(res, {"treated_share": 6, "control_share": 6})


_DUMMY_COLS = ["industry_2digit", "region", "has_subsidiaries", "materials", "year_1998", "covid_period",
               "dti_binary", "rd_employees_total"]


@register("dummy_columns", P("""
select variable, n_distinct, is_dummy, dummy_share, (dummy_share > 0.3)::int mostly_dummies from (
  select *, round(sum(is_dummy) over () / 8.0, 6) dummy_share from (
    select variable, n_distinct, (n_distinct <= 10 or lower(variable) like '%industry%' or lower(variable) like '%region%'
           or lower(variable) like '%year%')::int is_dummy from (
      """ + " union all ".join(f"select '{c}' variable, count(distinct {c})::bigint n_distinct from clean"
                               for c in _DUMMY_COLS) + """) a) b) c"""))
def q_dummy_columns(spark, sf_dir):
    return rounded(PR.dummy_columns(clean_firm_panel(spark, sf_dir), _DUMMY_COLS, count_all=True), {"dummy_share": 6})


_NUIS_SQL = """
cell as (select year, segment, region, avg(t) ps_raw, avg(case when t=1 then y end) m1,
                avg(case when t=0 then y end) m0, sum(t) n1, count(*) - sum(t) n0
         from base group by year, segment, region),
yr as (select year, avg(case when t=1 then y end) g1, avg(case when t=0 then y end) g0 from base group by year),
scored as (select b.*, {ps} ps,
                  case when n1 > 0 then m1 else coalesce(g1, 0) end mu1,
                  case when n0 > 0 then m0 else coalesce(g0, 0) end mu0
           from base b join cell using (year, segment, region) join yr using (year))"""


def _scored_orders(spark, sf_dir, clip=(0.01, 0.99)):
    return cell_nuisances(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"], clip=clip)


@register("propensity_diagnostics", S.with_orders(_NUIS_SQL.format(ps="ps_raw") + """,
f as (select year, count(ps) n, min(ps) ps_min, max(ps) ps_max, avg(ps) ps_mean, stddev_pop(ps) ps_std,
        greatest(min(case when t=1 then ps end), min(case when t=0 then ps end)) support_lo,
        least(max(case when t=1 then ps end), max(case when t=0 then ps end)) support_hi,
        count(case when ps < 0.3 then 1 end) n_below, count(case when ps > 0.5 then 1 end) n_above
      from scored group by year),
i as (select s.year, avg(case when ps >= support_lo and ps <= support_hi then 1.0 else 0.0 end) share_in
      from scored s join f using (year) group by s.year)""", """
select year, n::bigint n, round(ps_min, 6) ps_min, round(ps_max, 6) ps_max, round(ps_mean, 6) ps_mean,
  round(ps_std, 6) ps_std, round(support_lo, 6) support_lo, round(support_hi, 6) support_hi,
  n_below::bigint n_below, n_above::bigint n_above, round(share_in, 6) share_in_support,
  round(n_below / n, 6) share_below, round(n_above / n, 6) share_above
from f join i using (year)"""))
def q_propensity_diagnostics(spark, sf_dir):
    """#51 with thresholds .3/.5 (cell propensities of this panel sit in
    .2-.6, so the default .01/.99 would flag nothing)."""
    res = PR.propensity_diagnostics(_scored_orders(spark, sf_dir, clip=None), "ps", "t", lo=0.3, hi=0.5,
                                    by=["year"])
    return rounded(res, {}, default=6)


@register("clever_covariate_diagnostics", S.with_orders(_NUIS_SQL.format(
    ps="least(greatest(ps_raw, 0.01), 0.99)"), """
select year, round(avg(mu1), 6) mu1_mean, round(stddev_pop(mu1), 6) mu1_std, round(avg(mu0), 6) mu0_mean,
  round(stddev_pop(mu0), 6) mu0_std, round(avg(ps), 6) ps_mean, round(stddev_pop(ps), 6) ps_std,
  round(avg(t / ps), 6) h1_mean, round(max(t / ps), 6) h1_max, round(avg((1 - t) / (1 - ps)), 6) h0_mean,
  round(max((1 - t) / (1 - ps)), 6) h0_max
from scored group by year"""))
def q_clever(spark, sf_dir):
    return rounded(PR.clever_covariate_diagnostics(_scored_orders(spark, sf_dir), by=["year"]), {}, default=6)


@register("outcome_model_summary", S.with_orders(_NUIS_SQL.format(ps="ps_raw"), """
select year, round(avg(mu1), 6) mu1_mean, round(min(mu1), 6) mu1_min, round(max(mu1), 6) mu1_max,
  round(avg(mu0), 6) mu0_mean, round(min(mu0), 6) mu0_min, round(max(mu0), 6) mu0_max
from scored group by year"""))
def q_outcome_summary(spark, sf_dir):
    return rounded(PR.outcome_model_summary(_scored_orders(spark, sf_dir), by=["year"]), {}, default=6)


@register("outcome_correlation", P("""
select year, round(corr(a, b), 6) correlation, round(avg(a), 6) a_mean, round(avg(b), 6) b_mean, count(*)::bigint n
from (select year, ln(greatest(revenue, 1)) - 0.3 * ln(greatest(capital, 1)) - 0.7 * ln(greatest(employees, 1)) a,
             ln(greatest(revenue, 1)) - 0.5 * ln(greatest(capital, 1)) - 0.5 * ln(greatest(employees, 1)) b
      from clean) s where a is not null and b is not null group by year"""))
def q_outcome_correlation(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    y, k, l = X.log_floor("revenue"), X.log_floor("capital"), X.log_floor("employees")
    df = df.select("year", X.fixed_share_outcome(y, k, l).alias("a"), X.fixed_share_outcome(y, k, l, 0.5, 0.5).alias("b"))
    return rounded(PR.outcome_correlation(df, "a", "b", by=["year"]), {}, default=6)


@register("value_counts_top_k", P("""
select industry_2digit, n, (select count(*) from (select industry_2digit from clean group by industry_2digit
                             having count(*) >= 300) q)::bigint n_groups
from (select industry_2digit, count(*)::bigint n from clean group by industry_2digit having count(*) >= 300) c
order by n desc, industry_2digit limit 5"""))
def q_value_counts(spark, sf_dir):
    return PR.value_counts_top_k(clean_firm_panel(spark, sf_dir), "industry_2digit", k=5, min_rows=300)
