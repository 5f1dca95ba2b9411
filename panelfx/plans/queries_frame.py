"""Queries for sources, projections, filters and scalar expressions
(#2, #3, #13-41) on the firm-panel fixture and the order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import clean as C
from ..operators import frame as FR
from ..operators import production as PD
from ..operators.impute import impute_mean
from . import sqlfrag as S
from .catalog import register, rounded
from .firm import CLEAN_SQL, FIXTURE_ALIASES, clean_firm_panel
from .panel import CODE_COLUMNS, CODE_WAVE_CUTOFF, firm_panel, order_panel


def P(final: str, extra: str = "") -> str:
    """Oracle text: fixture CTE + cleaning CTEs (+ extra CTEs) + final select."""
    ctes = CLEAN_SQL.strip() + ("," + extra if extra else "")
    return S.with_panel(ctes, final)


# ------------------------------------------------------------------ #2 union
@register("union_years", S.with_panel("", """
select year, count(*)::bigint n, count(energy)::bigint n_energy, round(sum(revenue), 2) revenue
from (select year, revenue, null::double energy from panel where year <= 1997
      union all select year, revenue, energy from panel where year > 1997) u
group by year"""))
def q_union_years(spark, sf_dir):
    """Stack yearly pieces whose column sets differ (early years lack ``energy``)."""
    p = firm_panel(spark, sf_dir).select("year", "revenue", "energy")
    early = p.where(F.col("year") <= CODE_WAVE_CUTOFF).drop("energy")
    late = p.where(F.col("year") > CODE_WAVE_CUTOFF)
    u = FR.union_by_name([early, late])
    return u.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("energy").alias("n_energy"),
                                 F.round(F.sum("revenue"), 2).alias("revenue"))


# ------------------------------------------------- #3 snapshot missing count
@register("snapshot_before_imputation", P("""
select count(*)::bigint n_rows,
  (count(*) - count(industry_2digit)) + (count(*) - count(region)) + (count(*) - count(revenue))
  + (count(*) - count(employees)) + (count(*) - count(capital)) + (count(*) - count(materials))
  + (count(*) - count(energy)) + (count(*) - count(total_debt)) + (count(*) - count(rd_employees_total))
  + (count(*) - count(direct_export_amount)) + (count(*) - count(has_subsidiaries))
  + (count(*) - count(rd_employee_ratio)) + (count(*) - count(export_intensity)) as n_missing_cells
from clean"""))
def q_snapshot(spark, sf_dir):
    """#3: missing cells of the engineered table (the parquet write itself is
    ``sources.io.snapshot``)."""
    from ..sources.io import snapshot
    from .queries_io import scratch
    df = clean_firm_panel(spark, sf_dir, with_treatment=False)
    return snapshot(df, scratch(spark, "snapshot"))


# ------------------------------------------------------------ #13 sector
@register("filter_sector", S.with_panel("", """
select count(*)::bigint n_total, count(case when sector = 'MACHINERY' then 1 end)::bigint n_kept,
  round(100.0 * count(case when sector = 'MACHINERY' then 1 end) / count(*), 4) kept_pct,
  (select count(*) from panel where sector = 'MACHINERY' and year = 1996)::bigint n_kept_1996
from panel"""))
def q_filter_sector(spark, sf_dir):
    p = firm_panel(spark, sf_dir).select("sector", "year")
    share = FR.sector_share(p, "sector", "MACHINERY")
    kept = FR.filter_sector(p, "sector", "MACHINERY").where("year = 1996").agg(
        F.count(F.lit(1)).alias("n_kept_1996"))
    return rounded(FR.with_one_row(share, kept), {"kept_pct": 4})


# ------------------------------------------------------ #14 select/rename
def _selection_sql() -> str:
    # Written out: ``total_assets`` repeats the source of ``capital``, and ``equity`` is not in the panel.
    same = ["firm_id", "year", "industry_2digit", "region", "dti_iot", "dti_cloud", "dti_ai", "dti_bigdata", "revenue",
            "employees", "capital", "materials", "energy", "has_subsidiaries"]
    renamed = {"total_debt": "debt", "rd_employees_total": "rd_employees", "direct_export_amount": "exports_txt"}
    pairs = [*((c, c) for c in same), *renamed.items()]
    return " union all ".join(f"select '{a}' alias, '{s}' source, count({s})::bigint n_present from panel" for a, s in pairs)


@register("select_and_rename", S.with_panel("", _selection_sql()))
def q_select_and_rename(spark, sf_dir):
    """#14: alias map applied (first alias of a source wins, absent sources
    dropped); one row per kept alias with its present-value count."""
    renamed, sel = FR.select_and_rename(firm_panel(spark, sf_dir), FIXTURE_ALIASES)
    one = renamed.agg(*[F.count(a).alias(a) for a in sel.mapping])
    structs = [F.struct(F.lit(a).alias("alias"), F.lit(s).alias("source"), F.col(a).alias("n_present"))
               for a, s in sel.mapping.items()]
    return one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


# ------------------------------------------------- #15/#16 covariates
def covariates_of(columns):
    """All columns but the row key and those that the treatment and outcome steps use or make."""
    return FR.covariate_columns(columns, {*C.KEY_COLUMNS, *C.treatment_columns(), *PD.outcome_columns()})


_COVS = ["industry_2digit", "region", "materials", "energy", "total_debt", "rd_employees_total",
         "direct_export_amount", "has_subsidiaries", "rd_employee_ratio", "export_intensity",
         "year_1998", "year_1999", "year_2000", "year_2001", "covid_period"]


@register("covariate_columns", P(" union all ".join(
    f"select '{c}' variable, count({c})::bigint n_present from clean" for c in _COVS)))
def q_covariate_columns(spark, sf_dir):
    """#15 + #16: covariates = all columns minus the exclude list (checked
    against an expected count), with their present-value counts."""
    df = clean_firm_panel(spark, sf_dir)
    covs = covariates_of(df.columns)
    FR.check_covariates(covs, expected=len(_COVS))
    one = df.agg(*[F.count(c).alias(c) for c in covs])
    structs = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_present")) for c in covs]
    return one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


# ------------------------------------------------- #17 listwise deletion
@register("drop_missing_rows", P("""
select year, count(*)::bigint n from clean
where dti_binary is not null and revenue is not null and total_debt is not null
  and rd_employees_total is not null and direct_export_amount is not null
group by year"""))
def q_drop_missing(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    kept = FR.drop_missing_rows(df, ["dti_binary", "revenue", "total_debt", "rd_employees_total",
                                     "direct_export_amount"])
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------- #18 complete cases gate
@register("complete_cases", P("""
select industry_2digit, count(*)::bigint n from clean
where total_debt is not null and rd_employees_total is not null
group by industry_2digit
having count(*) >= 100 and sum(dti_binary) >= 10 and sum(1 - dti_binary) >= 10"""))
def q_complete_cases(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    cc = FR.complete_cases(df, ["total_debt", "rd_employees_total"], min_rows=100, by=["industry_2digit"],
                           min_per_arm=10, treatment="dti_binary")
    return cc.groupBy("industry_2digit").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------- #20 group-size gate
@register("group_size_gate", P("""
select industry_2digit, count(*)::bigint n, sum(dti_binary)::bigint n_treated from clean
where industry_2digit in (select industry_2digit from clean group by industry_2digit
                          having count(*) >= 300 and sum(dti_binary) >= 100)
group by industry_2digit"""))
def q_group_size_gate(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    kept = FR.group_size_gate(df, ["industry_2digit"], 300, treatment="dti_binary", min_treated=100)
    return kept.groupBy("industry_2digit").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("dti_binary").cast("long").alias("n_treated"))


# ------------------------------------------- #21 column-or-fallback, #30
@register("column_or_fallback", P("""
select year, round(avg(case when capital is not null then ln(greatest(capital, 1)) end), 6) k_mean,
  count(case when capital is not null then 1 end)::bigint n_k
from clean group by year"""))
def q_column_or_fallback(spark, sf_dir):
    """#21 + #30: capital column chosen from (capital, assets), then ln(max(x,1))."""
    df = clean_firm_panel(spark, sf_dir)
    kcol = FR.column_or_fallback(df.columns, ["capital", "assets"])
    k = X.log_floor(kcol)
    return df.groupBy("year").agg(F.round(F.avg(k), 6).alias("k_mean"), F.count(k).alias("n_k"))


# --------------------------------------------------------- #22 scatter back
@register("scatter_back", P("""
select year, count(v)::bigint n_defined, round(avg(v), 6) v_mean from (
  select year, case when total_debt is not null and rd_employees_total is not null
              then total_debt / (rd_employees_total + 1) end v from clean) s
group by year"""))
def q_scatter_back(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    df = FR.scatter_back(df, ["total_debt", "rd_employees_total"], "v",
                         F.col("total_debt") / (F.col("rd_employees_total") + 1))
    return df.groupBy("year").agg(F.count("v").alias("n_defined"), F.round(F.avg("v"), 6).alias("v_mean"))


# ------------------------------------------------------------ #23 Y/N
@register("yes_no_to_binary", S.with_panel("", """
select has_subsidiaries_raw, has_subsidiaries, count(*)::bigint n from (
  select has_subsidiaries has_subsidiaries_raw,
         case when has_subsidiaries = 'Y' then 1 when has_subsidiaries is not null then 0 end has_subsidiaries
  from panel) s group by all"""))
def q_yes_no(spark, sf_dir):
    p = firm_panel(spark, sf_dir).select(F.col("has_subsidiaries").alias("has_subsidiaries_raw"))
    out = p.withColumn("has_subsidiaries", X.yes_no_to_binary("has_subsidiaries_raw"))
    return out.groupBy("has_subsidiaries_raw", "has_subsidiaries").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- #24 numeric
@register("to_numeric", P("""
select count(*)::bigint n, count(direct_export_amount)::bigint n_parsed,
  round(sum(direct_export_amount), 2) total from clean"""))
def q_to_numeric(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("direct_export_amount").alias("n_parsed"),
                  F.round(F.sum("direct_export_amount"), 2).alias("total"))


# ----------------------------------------------------------- #25 recode
@register("recode_wave_codes", P("""
select year, dti_iot, count(*)::bigint n from clean group by all"""))
def q_recode(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    return df.groupBy("year", "dti_iot").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------- #26 / #27 treatment
@register("row_mean", P("""
select year, round(avg(dti_mean), 6) dti_mean,
  round(avg((coalesce(total_debt, 0) + coalesce(rd_employees_total, 0))
        / nullif((total_debt is not null)::int + (rd_employees_total is not null)::int, 0)), 4) mixed_mean,
  count((coalesce(total_debt, 0) + coalesce(rd_employees_total, 0))
        / nullif((total_debt is not null)::int + (rd_employees_total is not null)::int, 0))::bigint n_mixed
from clean group by year"""))
def q_row_mean(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    mixed = X.row_mean(["total_debt", "rd_employees_total"])
    return df.groupBy("year").agg(F.round(F.avg("dti_mean"), 6).alias("dti_mean"),
                                  F.round(F.avg(mixed), 4).alias("mixed_mean"), F.count(mixed).alias("n_mixed"))


@register("binarize_treatment", P("""
select year, sum(dti_binary)::bigint treated, sum(case when dti_mean - 1 > 0 then 1 else 0 end)::bigint treated_offset1,
  count(*)::bigint n from clean group by year"""))
def q_binarize(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    return df.groupBy("year").agg(F.sum("dti_binary").cast("long").alias("treated"),
                                  F.sum(X.binarize_treatment("dti_mean", 0.0, offset=1.0)).cast("long")
                                  .alias("treated_offset1"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------- #28 / #28b features
@register("ratio_features", P("""
select 'rd_employee_ratio' feature, round(avg(rd_employee_ratio), 6) mean, count(rd_employee_ratio)::bigint n from clean
union all select 'export_intensity', round(avg(export_intensity), 9), count(export_intensity)::bigint from clean"""))
def q_ratio_features(spark, sf_dir):
    """#28 + #28b: ratios made only where inputs exist, and their means."""
    df = clean_firm_panel(spark, sf_dir)
    _, made = C.ratio_features(df.drop(*[n for n, _, _ in C.RATIO_FEATURES if n in df.columns]))
    digits = {"rd_employee_ratio": 6, "export_intensity": 9}
    one = df.agg(*[F.round(F.avg(c), digits[c]).alias(f"m__{c}") for c in made],
                 *[F.count(c).alias(f"n__{c}") for c in made])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"m__{c}").alias("mean"), F.col(f"n__{c}").alias("n"))
               for c in made]
    return one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


_AUDIT = [n for n, _, _ in C.RATIO_FEATURES] + ["year_1998", "year_1999", "year_2000", "year_2001", "covid_period"]
_AUDIT_PRESENT = {"rd_employee_ratio": 6, "export_intensity": 9, "year_1998": 6, "year_1999": 6, "year_2000": 6,
                  "year_2001": 6, "covid_period": 6}


@register("feature_audit", P(" union all ".join(
    f"select '{n}' feature, {1 if n in _AUDIT_PRESENT else 0} present, "
    + (f"round(avg({n}), {_AUDIT_PRESENT[n]}) mean from clean" if n in _AUDIT_PRESENT else "null::double mean")
    for n in _AUDIT)))
def q_feature_audit(spark, sf_dir):
    """#28b: which of the 14 engineered columns exist, and the mean of each."""
    digits = F.when(F.col("feature") == "export_intensity", F.round("mean", 9)).otherwise(F.round("mean", 6))
    return C.feature_audit(clean_firm_panel(spark, sf_dir), _AUDIT).withColumn("mean", digits)


@register("recomputed_ratios", P("""
select round(avg(rd_employee_ratio), 6) before_mean, count(rd_employee_ratio)::bigint n_before,
  round(avg(coalesce(rd_employees_total, (select avg(rd_employees_total) from clean)) / (employees + 1e-6)), 6) after_mean, count(employees)::bigint n_after
from clean"""))
def q_recomputed_ratios(spark, sf_dir):
    """#28 with ``recompute_ratios``: the ratio of an imputed component made anew after mean imputation."""
    before = clean_firm_panel(spark, sf_dir)
    after = C.recomputed_ratios(impute_mean(before, ["rd_employees_total"]))
    a, b = (df.agg(F.round(F.avg("rd_employee_ratio"), 6).alias(f"{n}_mean"), F.count("rd_employee_ratio").alias(f"n_{n}")) for n, df in (("before", before), ("after", after)))
    return FR.with_one_row(a, b)


# ------------------------------------------------------- #29 dummies
@register("period_dummies", P("""
select sum(year_1998)::bigint year_1998, sum(year_1999)::bigint year_1999, sum(year_2000)::bigint year_2000,
  sum(year_2001)::bigint year_2001, sum(covid_period)::bigint covid_period from clean"""))
def q_period_dummies(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    return df.agg(*[F.sum(c).cast("long").alias(c) for c in
                    ("year_1998", "year_1999", "year_2000", "year_2001", "covid_period")])


# ------------------------------------------- #31 / #32 production inputs
@register("log_row_sum", P("""
select year, round(avg(ln(greatest(coalesce(materials, 0) + coalesce(energy, 0), 1))), 6) m_total,
  round(avg(ln(greatest(coalesce(total_debt, 0) + coalesce(rd_employees_total, 0), 1))), 6) sparse_total
from clean group by year"""))
def q_log_row_sum(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    return df.groupBy("year").agg(
        F.round(F.avg(X.log_row_sum(["materials", "energy"])), 6).alias("m_total"),
        F.round(F.avg(X.log_row_sum(["total_debt", "rd_employees_total"])), 6).alias("sparse_total"))


@register("fixed_share_outcome", P("""
select year, round(avg(ln(greatest(revenue, 1)) - 0.3 * ln(greatest(capital, 1)) - 0.7 * ln(greatest(employees, 1))), 6) tfp_simple
from clean group by year"""))
def q_fixed_share(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir)
    tfp = X.fixed_share_outcome(X.log_floor("revenue"), X.log_floor("capital"), X.log_floor("employees"))
    return df.groupBy("year").agg(F.round(F.avg(tfp), 6).alias("tfp_simple"))


# ------------------------------------------------------ #33 clipping
@register("clip_propensity", S.with_orders("""
cell as (select year, segment, region, avg(t) ps from base group by all)""", """
select year, count(*)::bigint n_cells, sum(case when ps < 0.2 or ps > 0.6 then 1 else 0 end)::bigint n_clipped,
  round(avg(least(greatest(ps, 0.2), 0.6)), 6) ps_clipped_mean from cell group by year"""))
def q_clip(spark, sf_dir):
    cells = order_panel(spark, sf_dir).groupBy("year", "segment", "region").agg(F.avg("t").alias("ps"))
    c = X.clip_propensity("ps", 0.2, 0.6)
    return cells.groupBy("year").agg(F.count(F.lit(1)).alias("n_cells"),
                                     F.sum(((F.col("ps") < 0.2) | (F.col("ps") > 0.6)).cast("long")).alias("n_clipped"),
                                     F.round(F.avg(c), 6).alias("ps_clipped_mean"))


# --------------------------------------- #34-#38 inference columns
@register("inference_columns", S.with_orders("", f"""
select segment, n, {S.r('ate')} ate, {S.r('se')} se, {S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper,
  {S.r('z', 4)} z, {S.r('p_value', 4)} p_value, {S.r('p_ref', 4)} p_ref,
  case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else '' end stars,
  {S.r('effect_pct', 4)} effect_pct
from (select *, {S.finish()},
        2 * (1 - 0.5 * (1 + sign(ate / se) * (1 - exp(-(ate / se) * (ate / se) / 2)))) p_ref
      from (select segment, count(*)::bigint n, avg(y) - 12 ate, stddev_samp(y) / sqrt(count(*)) se
            from base group by segment) g) f"""))
def q_inference(spark, sf_dir):
    """#34-#38 on per-segment estimates of mean(y) - 12: percent effect,
    normal CI, z and p (A&S polynomial), the reference-form p and stars."""
    g = order_panel(spark, sf_dir).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("y") - 12).alias("ate"),
        (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    lo, hi = X.normal_ci("ate", "se")
    z = F.col("ate") / F.col("se")
    out = g.select("segment", "n", "ate", "se", lo.alias("ci_lower"), hi.alias("ci_upper"), z.alias("z"),
                   X.normal_two_sided_p(z).alias("p_value"), X.p_value_reference_form(z).alias("p_ref"),
                   X.percent_effect("ate").alias("effect_pct"))
    out = out.withColumn("stars", X.significance_stars("p_value"))
    return rounded(out, {"ate": 6, "se": 6, "ci_lower": 6, "ci_upper": 6, "z": 4, "p_value": 4, "p_ref": 4,
                         "effect_pct": 4})


# -------------------------------------------------------- #39 periods
_PL = ("Early (1995)", "Middle (1996-1997)", "Late (1998-2001)")
_PY = ((1995,), (1996, 1997), (1998, 1999, 2000, 2001))


@register("period_label", P(f"""
select period, count(*)::bigint n, sum(dti_binary)::bigint n_treated from (
  select case when year in (1996, 1997) then '{_PL[1]}' when year in (1998, 1999, 2000, 2001) then '{_PL[2]}'
              else '{_PL[0]}' end period, dti_binary from clean) s group by period"""))
def q_period_label(spark, sf_dir):
    df = clean_firm_panel(spark, sf_dir).withColumn("period", X.period_label("year", _PL, _PY))
    return df.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("dti_binary").cast("long").alias("n_treated"))


# -------------------------------------------------- #40 / #41 quantile bins
@register("quantile_bucket", S.with_panel(CLEAN_SQL.strip() + """,
e as (select quantile_cont(revenue, [0.0, 0.25, 0.5, 0.75, 1.0]) q from clean where dti_binary = 1),
b as (select case when revenue < q[1] or revenue > q[5] then null when revenue <= q[2] then 'Q1 (Low)'
                  when revenue <= q[3] then 'Q2' when revenue <= q[4] then 'Q3' else 'Q4 (High)' end quartile
      from clean, e where dti_binary = 1)""", "select quartile, count(*)::bigint n from b group by quartile"))
def q_quantile_bucket(spark, sf_dir):
    from ..operators.bins import quantile_bucket
    df = clean_firm_panel(spark, sf_dir).where("dti_binary = 1")
    out = quantile_bucket(df, "revenue", 4, ["Q1 (Low)", "Q2", "Q3", "Q4 (High)"], out="quartile")
    return out.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"))


@register("coarsen", S.with_panel(CLEAN_SQL.strip() + """,
e as (select quantile_cont(revenue, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) q from clean),
b as (select (revenue >= q[2])::int + (revenue >= q[3])::int + (revenue >= q[4])::int + (revenue >= q[5])::int bin
      from clean, e)""", "select bin, count(*)::bigint n from b group by bin"))
def q_coarsen(spark, sf_dir):
    from ..operators.bins import coarsen
    df = clean_firm_panel(spark, sf_dir)
    out = coarsen(df, ["revenue"], n_bins=5)
    return out.groupBy(F.col("revenue_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------ #69 / #70 keys
@register("attach_by_key", P("""
select year, count(*)::bigint n, sum(dti_binary)::bigint n_treated, round(sum(revenue), 2) revenue from clean
group by year"""))
def q_attach(spark, sf_dir):
    """#69: two column blocks of the same rows put side by side by
    (firm_id, year) instead of by position."""
    df = clean_firm_panel(spark, sf_dir)
    ids = df.select("firm_id", "year", "dti_binary")
    vals = df.select("firm_id", "year", "revenue")
    j = FR.attach_by_key(ids, vals, ["firm_id", "year"])
    return j.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("dti_binary").cast("long").alias("n_treated"),
                                 F.round(F.sum("revenue"), 2).alias("revenue"))


@register("align_with_fill", P("""
select year, count(*)::bigint n, count(case when dti_binary = 1 and total_debt is not null then 1 end)::bigint n_member
from clean group by year"""))
def q_align(spark, sf_dir):
    """#70: membership of a subset as a flag, false elsewhere."""
    df = clean_firm_panel(spark, sf_dir)
    subset = df.where("dti_binary = 1 and total_debt is not null")
    out = FR.align_with_fill(df, subset, ["firm_id", "year"], "member")
    return out.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("member").cast("long")).alias("n_member"))
