"""Queries for regression, production, nuisances, effects, pooling,
resampling, splits and imputation (#71-102)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import effects as E
from ..operators import heterogeneity as HT
from ..operators import impute as IM
from ..operators import learners as LN
from ..operators import logistic as LG
from ..operators import production as PD
from ..operators import resample as RS
from ..operators.gram import ols
from ..operators.learners import join_on_keys
from ..session import cut_lineage
from . import sqlfrag as S
from .catalog import register, rounded
from .firm import CLEAN_SQL, clean_firm_panel
from .panel import order_panel

EFF = {"ate": 6, "se": 6, "ci_lower": 6, "ci_upper": 6, "z": 4, "p_value": 4, "effect_pct": 4,
       "treated_pct": 4}
EST = ["n", "n_treated", "treated_pct", "ate", "se", "ci_lower", "ci_upper", "z", "p_value", "effect_pct"]


def firm_analysis(spark, sf_dir):
    """Cleaned panel reduced to the analysis columns: treatment t, outcome y
    (fixed-share productivity), a cell covariate hs (Y/N with missing as its
    own level) and the partly missing covariates."""
    df = clean_firm_panel(spark, sf_dir)
    y = X.fixed_share_outcome(X.log_floor("revenue"), X.log_floor("capital"), X.log_floor("employees"))
    return df.select("firm_id", "year", F.col("dti_binary").alias("t"), "dti_mean", y.alias("y"),
                     F.coalesce(F.col("has_subsidiaries"), F.lit(-1.0)).alias("hs"), "region", "industry_2digit",
                     "total_debt", "rd_employees_total", "direct_export_amount")


FA_SQL = CLEAN_SQL.strip() + """,
fa as (select firm_id, year, dti_binary t, dti_mean,
         ln(greatest(revenue, 1)) - 0.3 * ln(greatest(capital, 1)) - 0.7 * ln(greatest(employees, 1)) y,
         coalesce(has_subsidiaries, -1.0) hs, region, industry_2digit, total_debt, rd_employees_total,
         direct_export_amount from clean)"""


def FA(final: str, extra: str = "") -> str:
    return S.with_panel(FA_SQL + ("," + extra if extra else ""), final)


def O(final: str, extra: str = "") -> str:
    return S.with_orders(extra.strip().lstrip(",") if extra else "", final)


def _est_cols(key: str | None = None, src: str = "est") -> str:
    k = f"{key}, " if key else ""
    return (f"select {k}n::bigint n, n_treated::bigint n_treated, {S.r('treated_pct', 4)} treated_pct, "
            f"{S.r('ate')} ate, {S.r('se')} se, {S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper, "
            f"{S.r('z', 4)} z, {S.r('p_value', 4)} p_value, {S.r('effect_pct', 4)} effect_pct "
            f"from (select *, {S.finish()} from {src}) e")


def _cell_sql(base: str, keys: list[str], cells: list[str], t: str = "t", y: str = "y", clip: bool = True,
              name: str = "sc") -> str:
    """CTEs computing ps (clipped or not), mu1, mu0 per row from cell means
    within ``keys`` (arm fallback: mean over the key group, then 0)."""
    k = ", ".join(keys)
    kc = ", ".join(keys + cells)
    ps = "least(greatest(ps_raw, 0.01), 0.99)" if clip else "ps_raw"
    on_cells = " and ".join(f"b.{c} is not distinct from c.{c}" for c in keys + cells)
    on_keys = " and ".join(f"b.{c} is not distinct from g.{c}" for c in keys) if keys else "true"
    grp = f"select {k}, " if keys else "select "
    gby = f"group by {k}" if keys else ""
    return f"""
{name}_c as (select {kc}, avg({t}) ps_raw, avg(case when {t} = 1 then {y} end) m1,
        avg(case when {t} = 0 then {y} end) m0, sum({t}) n1, count(*) - sum({t}) n0 from {base} group by {kc}),
{name}_g as ({grp}avg(case when {t} = 1 then {y} end) g1, avg(case when {t} = 0 then {y} end) g0
        from {base} {gby}),
{name} as (select b.*, {ps} ps, case when n1 > 0 then m1 else coalesce(g1, 0) end mu1,
        case when n0 > 0 then m0 else coalesce(g0, 0) end mu0
        from {base} b join {name}_c c on {on_cells} join {name}_g g on {on_keys})"""


def _aipw_sql(src: str, keys: list[str], t: str = "t", y: str = "y", name: str = "est") -> str:
    k = ", ".join(keys)
    sel = f"{k}, " if keys else ""
    gby = f"group by {k}" if keys else ""
    return f"""
{name} as (select {sel}count(*) n, sum({t}) n_treated, 100.0 * sum({t}) / count(*) treated_pct, avg(psi) ate,
        sqrt(var_pop(psi) / count(*)) se
        from (select *, {t} * ({y} - mu1) / ps + mu1 - (1 - {t}) * ({y} - mu0) / (1 - ps) - mu0 psi from {src}) s
        {gby})"""


# ------------------------------------------------------------- #77 / #78
_POLY = [("poly_k_k", "zk*zk"), ("poly_k_m", "zk*zm"), ("poly_m_m", "zm*zm"), ("poly_k_k_k", "zk*zk*zk"),
         ("poly_k_k_m", "zk*zk*zm"), ("poly_k_m_m", "zk*zm*zm"), ("poly_m_m_m", "zm*zm*zm")]


@register("polynomial_terms", S.with_panel(CLEAN_SQL.strip() + """,
li2 as (select ln(greatest(revenue, 1)) y, ln(greatest(capital, 1)) k, ln(greatest(employees, 1)) l,
        ln(greatest(coalesce(materials, 0) + coalesce(energy, 0), 1)) m from clean),
ok as (select * from li2 where y is not null and k is not null and l is not null and m is not null),
st as (select avg(k) km, stddev_pop(k) ks, avg(m) mm, stddev_pop(m) ms from ok),
z as (select (k - km) / ks zk, (m - mm) / ms zm from ok, st)""",
    "select count(*)::bigint n, " + ", ".join(f"round(avg({e}), 6) {n}" for n, e in _POLY) + " from z"))
def q_poly(spark, sf_dir):
    """#77: the cubic in standardized (k, m); means of the degree-2/3 terms
    (degree-1 means are 0 by construction)."""
    d = PD.log_inputs(clean_firm_panel(spark, sf_dir)).where("y is not null and k is not null and l is not null")
    st = d.agg(F.avg("k").alias("km"), F.stddev_pop("k").alias("ks"), F.avg("m").alias("mm"),
               F.stddev_pop("m").alias("ms"))
    d = d.crossJoin(F.broadcast(st))
    src = {"k": (F.col("k") - F.col("km")) / F.col("ks"), "m": (F.col("m") - F.col("mm")) / F.col("ms")}
    terms = dict(PD.polynomial_terms(["k", "m"], 3, src))
    return d.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(terms[n]), 6).alias(n) for n, _ in _POLY])


@register("ols", S.with_panel(CLEAN_SQL.strip() + """,
li2 as (select year, ln(greatest(revenue, 1)) y, ln(greatest(employees, 1)) l from clean)""", """
select year, count(*)::bigint n, round(regr_intercept(y, l), 6) intercept, round(regr_slope(y, l), 6) slope,
  round(regr_r2(y, l), 6) r2 from li2 where y is not null and l is not null group by year"""))
def q_ols(spark, sf_dir):
    """#78: least squares per group from cross-product sums."""
    d = PD.log_inputs(clean_firm_panel(spark, sf_dir))
    c = ols(d, "y", ["l"], by=["year"])
    return c.select("year", F.col("n").cast("long").alias("n"), F.round(F.col("coef").getItem(0), 6).alias("intercept"),
                    F.round(F.col("coef").getItem(1), 6).alias("slope"), F.round("r2", 6).alias("r2"))


_LOGS_SQL = CLEAN_SQL.strip() + """,
li2 as (select ln(greatest(revenue, 1)) y, ln(greatest(capital, 1)) k, ln(greatest(employees, 1)) l,
        ln(greatest(coalesce(materials, 0) + coalesce(energy, 0), 1)) m from clean),
ok as (select * from li2 where y is not null and k is not null and l is not null and m is not null)"""


@register("productivity_stage1", S.with_panel(_LOGS_SQL, """select count(*)::bigint n, 1 identified, round(avg(y), 6) fitted_mean,
  """ + ", ".join(f"1 orthogonal_{c}" for c in ("l", "k", "m", "kk", "km")) + " from ok"))
def q_stage1(spark, sf_dir):
    """#79: y on l + cubic(k, m).  The fit solves its normal equations: the
    fitted values have the mean of y, and the residual is uncorrelated with
    every regressor (|r| below 1e-8)."""
    d = PD.log_inputs(clean_firm_panel(spark, sf_dir))
    rows, beta = PD.productivity_stage1(d)
    fitted = F.col("phi_hat") + F.col("beta_l") * F.col("l")
    d = rows.where("phi_hat is not null").withColumns({"fitted": fitted, "rest": F.col("y") - fitted, "kk": F.col("k") * F.col("k"), "km": F.col("k") * F.col("m")})
    checks = [(F.abs(F.corr("rest", c)) < 1e-8).cast("int").alias(f"orthogonal_{c}") for c in ("l", "k", "m", "kk", "km")]
    one = d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 6).alias("fitted_mean"), *checks)
    return one.crossJoin(F.broadcast(beta.select(F.col("stage1_identified").cast("int").alias("identified"))))


@register("productivity_stage2", S.with_panel(_LOGS_SQL, """select count(*)::bigint n, 0.01::double beta_k, 1 at_bound,
  round(avg(y - 0.3 * k - 0.7 * l), 6) tfp_simple_mean, 0.0::double lp_gap from ok"""))
def q_stage2(spark, sf_dir):
    """#80: bounded closed-form capital coefficient, which sits at the bound;
    ``lp_gap`` is the mean of tfp_lp less y - beta_l l - beta_k k at the means."""
    d, est = PD.add_outcomes(clean_firm_panel(spark, sf_dir))
    means = d.where("tfp_lp is not null").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("y", "k", "l", "tfp_lp", "tfp_simple")])
    both = est.select("beta_l", "beta_k", F.col("at_bound").cast("int").alias("at_bound")).crossJoin(F.broadcast(means))
    gap = F.abs(F.col("tfp_lp") - (F.col("y") - F.col("beta_l") * F.col("l") - F.col("beta_k") * F.col("k")))
    return both.select("n", F.round("beta_k", 6).alias("beta_k"), "at_bound", F.round("tfp_simple", 6).alias("tfp_simple_mean"), F.round(gap, 6).alias("lp_gap"))


# ------------------------------------------------------------- #85 folds
_FOLD = "(('0x' || substr(md5('42:' || cast(id as varchar)), 1, 13))::bigint % 5)"


@register("fold_assign", O(f"select {_FOLD} fold, count(*)::bigint n, sum(t)::bigint n_treated from base group by 1"))
def q_folds(spark, sf_dir):
    d = RS.fold_assign(order_panel(spark, sf_dir), 5, 42, ["id"])
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("t").cast("long").alias("n_treated"))


# ------------------------------------------------- #86 / #87 / #89 crossfit
_CF_SQL = f"""
d as (select *, {_FOLD} fold from base),
cf as (select year, fold, segment, region, count(*) c, sum(t) n1, coalesce(sum(case when t = 1 then y end), 0) s1,
        coalesce(sum(case when t = 0 then y end), 0) s0 from d group by all),
ct as (select year, segment, region, sum(c) c_all, sum(n1) n1_all, sum(s1) s1_all, sum(s0) s0_all from cf group by all),
gf as (select year, fold, sum(c) gc, sum(n1) gn1, sum(s1) gs1, sum(s0) gs0 from cf group by all),
gt as (select year, sum(c) gc_all, sum(n1) gn1_all, sum(s1) gs1_all, sum(s0) gs0_all from cf group by year),
tab as (select cf.*, c_all - c cc, n1_all - n1 n1c, s1_all - s1 s1c, s0_all - s0 s0c,
          gc_all - gc gcc, gn1_all - gn1 gn1c, gs1_all - gs1 gs1c, gs0_all - gs0 gs0c
        from cf join ct using (year, segment, region) join gf using (year, fold) join gt using (year)),
nu0 as (select *, case when gn1c > 0 then gs1c / gn1c else 0 end gmu1,
          case when gcc - gn1c > 0 then gs0c / (gcc - gn1c) else 0 end gmu0 from tab),
nu as (select year, fold, segment, region,
          least(greatest(case when cc > 0 then n1c / cc when gcc > 0 then gn1c / gcc end, 0.01), 0.99) ps,
          case when gn1c > 10 then (case when n1c > 0 then s1c / n1c else gmu1 end) else gmu1 end mu1,
          case when gcc - gn1c > 10 then (case when cc - n1c > 0 then s0c / (cc - n1c) else gmu0 end) else gmu0 end mu0
        from nu0),
sc as (select d.*, ps, mu1, mu0, mu1 - mu0 + t / ps * (y - mu1) - (1 - t) / (1 - ps) * (y - mu0) psi
       from d join nu using (year, fold, segment, region)),
est as (select year, count(psi) n, sum(t) n_treated, 100.0 * sum(t) / count(psi) treated_pct, avg(psi) ate,
        sqrt(var_samp(psi) / count(psi)) se from sc group by year)"""


@register("aipw_crossfit", O(_est_cols("year"), _CF_SQL))
def q_crossfit(spark, sf_dir):
    """#89 with #86/#87: 5-fold cross-fitted AIPW, cell nuisances from the
    other folds, small-arm fallback, variance n-1."""
    res = RS.crossfit_cell_aipw(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], ["id"], ["year"], 5, 42)
    return rounded(res.select("year", *EST), EFF)


def _fold_lines_sql(base: str, key: str, x: str) -> str:
    """CTEs with the least-squares lines per (key, fold): propensity over all
    rows of the other folds, outcome per arm of them, and of the whole arms."""
    parts = []
    for name, target, cond in (("ps", "t", "true"), ("mu1", "y", "t = 1"), ("mu0", "y", "t = 0")):
        parts.append(f"""
l_{name} as (select {key}, f, regr_intercept({target}, {x}) a_{name}, regr_slope({target}, {x}) b_{name}
  from {base}, range(5) ff(f) where fold <> f and {cond} group by {key}, f)""")
    for name, cond in (("w1", "t = 1"), ("w0", "t = 0")):
        parts.append(f"""
l_{name} as (select {key}, regr_intercept(y, {x}) a_{name}, regr_slope(y, {x}) b_{name} from {base} where {cond} group by {key})""")
    joins = " ".join(f"join l_{n} on l_{n}.{key} = d.{key} and l_{n}.f = d.fold" for n in ("ps", "mu1", "mu0"))
    joins += " " + " ".join(f"join l_{n} on l_{n}.{key} = d.{key}" for n in ("w1", "w0"))
    return ",".join(parts) + f""",
fit as (select d.*, least(greatest(a_ps + b_ps * {x}, 0.01), 0.99) ps, a_mu1 + b_mu1 * {x} mu1, a_mu0 + b_mu0 * {x} mu0,
          case when t = 1 then a_mu1 + b_mu1 * {x} else a_w1 + b_w1 * {x} end own1,
          case when t = 0 then a_mu0 + b_mu0 * {x} else a_w0 + b_w0 * {x} end own0
        from {base} d {joins})"""


_XFIT_SQL = f"""
d as (select *, cast(region as double) x, {_FOLD} fold from base),{_fold_lines_sql('d', 'year', 'x')},
sc as (select *, {{psi}} psi from fit),
est as (select year, count(*) n, sum(t) n_treated, 100.0 * sum(t) / count(*) treated_pct, avg(psi) ate,
          sqrt(var_samp(psi) / count(*)) se from sc group by year)"""


@register("aipw_crossfit_linear", O(_est_cols("year"), _XFIT_SQL.format(
    psi="mu1 - mu0 + t / ps * (y - mu1) - (1 - t) / (1 - ps) * (y - mu0)")))
def q_crossfit_linear(spark, sf_dir):
    """#86 + #89 with the ``linear`` learner: all folds' models from one pass
    of cross products (group less fold)."""
    d = order_panel(spark, sf_dir).withColumn("x", F.col("region").cast("double"))
    return rounded(RS.crossfit_aipw(d, "t", "y", ["x"], ["id"], ["year"], learner="linear").select("year", *EST), EFF)


@register("aipw_crossfit_arms", O(_est_cols("year"), _XFIT_SQL.format(
    psi="own1 - own0 + t / ps * (y - own1) - (1 - t) / (1 - ps) * (y - own0)")))
def q_crossfit_arms(spark, sf_dir):
    """#86 as the placebo study has it: a row's own arm predicts it out of
    fold, the other arm by a model of that whole arm."""
    d = order_panel(spark, sf_dir).withColumn("x", F.col("region").cast("double"))
    return rounded(RS.crossfit_aipw(d, "t", "y", ["x"], ["id"], ["year"], learner="linear", other_arm="full").select("year", *EST), EFF)


# ------------------------------------------------------------------ #90
_TMLE_SQL = _cell_sql("base", ["year"], ["segment", "region"], clip=False) + """,
gq as (select *, least(greatest(ps, 0.01), 0.99) g from sc),
ep as (select year, sum((t / g - (1 - t) / (1 - g)) * (y - (t * mu1 + (1 - t) * mu0)))
          / sum((t / g - (1 - t) / (1 - g)) * (t / g - (1 - t) / (1 - g))) epsilon from gq group by year),
st as (select gq.*, epsilon, mu1 + epsilon / g m1s, mu0 - epsilon / (1 - g) m0s from gq join ep using (year)),
est as (select year, count(*) n, sum(t) n_treated, 100.0 * sum(t) / count(*) treated_pct, avg(m1s - m0s) ate,
          sqrt(var_pop(t / g * (y - m1s) - (1 - t) / (1 - g) * (y - m0s) + m1s - m0s) / count(*)) se,
          max(epsilon) epsilon from st group by year)"""


@register("tmle_effect", O(_est_cols("year, round(epsilon, 8) epsilon"), _TMLE_SQL))
def q_tmle(spark, sf_dir):
    """#90: one-step TMLE with cell nuisances per year."""
    res = HT.tmle_cell(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], ["year"])
    return rounded(res.select("year", "epsilon", *EST), {**EFF, "epsilon": 8})


@register("tmle_linear", O(_est_cols("year, round(epsilon, 8) epsilon, 0.0::double score_sum"), """
bl as (select *, cast(region as double) x from base),
c1 as (select year, regr_intercept(t, x) a_t, regr_slope(t, x) b_t from bl group by year),
c2 as (select year, regr_intercept(y, x) a_1, regr_slope(y, x) b_1 from bl where t = 1 group by year),
c3 as (select year, regr_intercept(y, x) a_0, regr_slope(y, x) b_0 from bl where t = 0 group by year),
sc as (select bl.*, a_t + b_t * x ps, a_1 + b_1 * x mu1, a_0 + b_0 * x mu0
       from bl join c1 using (year) join c2 using (year) join c3 using (year)),
gq""" + _TMLE_SQL.split("\ngq")[1]))
def q_tmle_linear(spark, sf_dir):
    """#90 with fitted nuisances: targeting on row scores in one aggregation;
    ``score_sum`` is the targeted equation sum H (Y - Q*)."""
    d = order_panel(spark, sf_dir).withColumn("x", F.col("region").cast("double"))
    res = E.tmle(d, "t", "y", ["x"], "linear", ["year"]).withColumn("score_sum", F.round(F.abs("score_sum"), 6))
    return rounded(res.select("year", "epsilon", "score_sum", *EST), {**EFF, "epsilon": 8})


# ------------------------------------------------------------------ #91
_POOL_SQL = _cell_sql("base", ["year"], ["segment", "region"]) + "," + _aipw_sql("sc", ["year"]) + """,
pl as (select count(*) m_n, avg(ate) ate, avg(se * se) w, var_samp(ate) b from est),
pl2 as (select *, w + (1 + 1.0 / m_n) * b total_var, sqrt(w + (1 + 1.0 / m_n) * b) se,
          case when b > 0 then (m_n - 1) * pow(1 + w / ((1 + 1.0 / m_n) * b), 2) end df from pl)"""


@register("pool_rubin", O(f"""select m_n::bigint "M", {S.r('ate')} ate, round(w, 10) "W", round(b, 10) "B",
  round(total_var, 10) total_var, {S.r('se')} se, round(df, 2) df, {S.r('ate - 1.96 * se')} ci_lower,
  {S.r('ate + 1.96 * se')} ci_upper, round(ate / se, 4) t_stat, round({S.p_value('ate / se')}, 4) p_value,
  round(100.0 * (exp(ate) - 1), 4) effect_pct from pl2""", _POOL_SQL))
def q_pool(spark, sf_dir):
    """#91 (normal form): Rubin's rules over grouped estimates (here the
    per-year AIPW rows play the role of the M imputations)."""
    per = E.cell_aipw(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"])
    res = E.pool_rubin(per, [], reference="z")
    return rounded(res.select("M", "ate", "W", "B", "total_var", "se", "df", "ci_lower", "ci_upper", "t_stat",
                              "p_value", "effect_pct"),
                   {"ate": 6, "W": 10, "B": 10, "total_var": 10, "se": 6, "df": 2, "ci_lower": 6, "ci_upper": 6,
                    "t_stat": 4, "p_value": 4, "effect_pct": 4})


@register("pool_rubin_t", O(f"""select m_n::bigint "M", {S.r('ate')} ate, round(w, 10) "W", round(b, 10) "B",
  round(total_var, 10) total_var, {S.r('se')} se, round(df, 2) df, round(ate / se, 4) t_stat,
  round(100.0 * (exp(ate) - 1), 4) effect_pct, 1 t_interval from pl2""", _POOL_SQL))
def q_pool_t(spark, sf_dir):
    """#91 (Student-t form).  Quantile and tail come from a pandas UDF on the
    pooled row; ``t_interval`` tells that the interval is wider than the normal
    one around the same centre and the p value in (0, 1)."""
    per = E.cell_aipw(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"])
    res = E.pool_rubin(per, [], reference="t")
    centred = F.abs((F.col("ci_lower") + F.col("ci_upper")) / 2 - F.col("ate")) < 1e-12
    wider = (F.col("ci_upper") - F.col("ci_lower")) / (2 * F.col("se")) > 1.9599
    res = res.withColumn("t_interval", (centred & wider & F.col("p_value").between(0, 1)).cast("int"))
    return rounded(res.select("M", "ate", "W", "B", "total_var", "se", "df", "t_stat", "effect_pct", "t_interval"),
                   {"ate": 6, "W": 10, "B": 10, "total_var": 10, "se": 6, "df": 2, "t_stat": 4, "effect_pct": 4})


# ----------------------------------------------------------------- #92d
_REG_SQL = """
rg as (select year, count(*) n, var_pop(t) * count(*) stt, var_pop(region) * count(*) sxx,
         covar_pop(t, region) * count(*) stx, covar_pop(t, y) * count(*) sty, covar_pop(region, y) * count(*) sxy,
         var_pop(y) * count(*) syy from base group by year),
rb as (select *, stt * sxx - stx * stx det from rg),
rc as (select *, (sty * sxx - sxy * stx) / det bt, (sxy * stt - sty * stx) / det bx from rb),
est as (select year, n, bt ate, sqrt((syy - bt * sty - bx * sxy) / (n - 3) * sxx / det) se from rc)"""


@register("effect_regression", O(f"""select year, n::bigint n, {S.r('ate')} ate, {S.r('se')} se,
  {S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper, {S.r('z', 4)} z, {S.r('p_value', 4)} p_value,
  {S.r('effect_pct', 4)} effect_pct from (select *, {S.finish()} from est) e""", _REG_SQL))
def q_regression(spark, sf_dir):
    """#92d: y on T + region per year; se from sigma^2 (Z'Z)^-1 (intercept included)."""
    d = order_panel(spark, sf_dir).withColumn("region", F.col("region").cast("double"))
    res = HT.effect_regression(d, "t", "y", ["region"], by=["year"])
    return rounded(res.select("year", "n", "ate", "se", "ci_lower", "ci_upper", "z", "p_value", "effect_pct"), EFF)


# ---------------------------------------------------------- #93 / #93b
# P(K <= k) of Poisson(1), k = 0, 1, 2, ... until 1 in double precision.
_POISSON1_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238463, 0.9963401531726563,
                0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745216,
                0.9999999899522336, 0.9999999991683892, 0.9999999999364022, 0.9999999999954802, 0.9999999999997,
                0.9999999999999813, 0.9999999999999989, 0.9999999999999999, 1.0]


def _poisson_case(u: str) -> str:
    parts = " ".join(f"when {u} < {v!r}::double then {k}" for k, v in enumerate(_POISSON1_CDF))
    return f"(case {parts} else {len(_POISSON1_CDF)} end)"


_U_BOOT = ("((('0x' || substr(md5('42:' || cast(bb as varchar) || ':' || cast(firm_id as varchar) || ':' "
           "|| cast(year as varchar)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double)")

# Four draws of 32 bits from each hash of (seed, block, key).
_U_CEM = ("((('0x' || substr(md5('42:' || cast((bb - 1) // 4 as varchar) || ':' || cast(firm_id as varchar) || ':' "
          "|| cast(year as varchar)), ((bb - 1) % 4 * 8 + 1)::int, 8))::bigint::double + 0.5) / 4294967296.0::double)")

_CEM_SQL = f"""
cc0 as (select * from fa where total_debt is not null and rd_employees_total is not null),
cc as (select * from cc0 where (select count(*) >= 100 and sum(t) >= 10 and sum(1 - t) >= 10 from cc0)),
ed as (select quantile_cont(total_debt, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) qd,
         quantile_cont(rd_employees_total, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) qr from cc),
bins as (select cc.*, (total_debt >= qd[2])::int + (total_debt >= qd[3])::int + (total_debt >= qd[4])::int
           + (total_debt >= qd[5])::int bd,
         (rd_employees_total >= qr[2])::int + (rd_employees_total >= qr[3])::int + (rd_employees_total >= qr[4])::int
           + (rd_employees_total >= qr[5])::int br from cc, ed),
sd as (select bd, br, count(case when t = 1 then 1 end) n_t, count(case when t = 0 then 1 end) n_c,
         avg(case when t = 1 then y end) - avg(case when t = 0 then y end) diff from bins group by bd, br
       having count(case when t = 1 then 1 end) > 0 and count(case when t = 0 then 1 end) > 0),
pt as (select sum((n_t + n_c) * diff) / sum(n_t + n_c) ate, sum(n_t + n_c) n_matched, count(*) n_strata from sd),
bt as (select * from (select bins.*, r.bb, {_poisson_case(_U_CEM)} w from bins, range(1, 51) r(bb)) x where w > 0),
bs as (select bb, bd, br, sum(case when t = 1 then w end) n_t, sum(case when t = 0 then w end) n_c,
         sum(case when t = 1 then w * y end) / sum(case when t = 1 then w end)
         - sum(case when t = 0 then w * y end) / sum(case when t = 0 then w end) diff
       from bt group by bb, bd, br having sum(case when t = 1 then w end) > 0 and sum(case when t = 0 then w end) > 0),
ba as (select bb, sum((n_t + n_c) * diff) / sum(n_t + n_c) ate from bs group by bb),
est as (select pt.*, (select stddev_samp(ate) from ba) se from pt)"""


@register("effect_matched_strata", FA(f"""select n_matched::bigint n_matched, n_strata::bigint n_strata,
  {S.r('ate')} ate, {S.r('se')} se, {S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper, {S.r('z', 4)} z,
  {S.r('p_value', 4)} p_value from (select *, {S.finish()} from est) e""", _CEM_SQL))
def q_cem(spark, sf_dir):
    """#93 + #93b: coarsened exact matching on two covariates (5 bins),
    stratum-size weights, Poisson bootstrap se (B = 50)."""
    d = firm_analysis(spark, sf_dir)
    res = HT.effect_matched_strata(d, "t", "y", ["total_debt", "rd_employees_total"], B=50, seed=42,
                                   key=["firm_id", "year"])
    return rounded(res.select(F.col("n_matched").cast("long").alias("n_matched"),
                              F.col("n_strata").cast("long").alias("n_strata"), "ate", "se", "ci_lower",
                              "ci_upper", "z", "p_value"), EFF)


_BOOT_SQL = f"""
bt as (select * from (select fa.*, r.bb, {_poisson_case(_U_BOOT)} w from fa, range(1, 101) r(bb)) x where w > 0),
bm as (select year, bb, sum(w * y) / sum(w) mean_b from bt group by year, bb),
bse as (select year, stddev_samp(mean_b) se from bm group by year)"""


@register("bootstrap_se", FA("""select year, n::bigint n, round(mean, 6) mean, round(se, 6) se from
  (select year, count(*) n, avg(y) mean from fa group by year) a join bse using (year)""", _BOOT_SQL))
def q_bootstrap(spark, sf_dir):
    """#93b: Poisson(1) bootstrap (B = 100, md5 draws) of the mean outcome per year."""
    d = firm_analysis(spark, sf_dir)
    reps = RS.bootstrap_sums(d, {"w": F.lit(1.0), "wy": F.col("y")}, 100, 42, ["firm_id", "year"], ["year"], own_hash=True)
    bm = reps.select("year", (F.col("wy") / F.col("w")).alias("mean_b"))
    se = bm.groupBy("year").agg(F.stddev_samp("mean_b").alias("se"))
    base = d.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    return rounded(base.join(se, "year"), {"mean": 6, "se": 6})


# ------------------------------------------------------------ #94-#96
R_PLACEBO = 200


def _perm_sql(moved: str, suf: str = "") -> str:
    """Rows in the order of a replicate's draws; T (or Y) handed out in turn."""
    h = ("(('0x' || substr(md5('42:' || cast(r as varchar) || ':' || cast(firm_id as varchar) || ':' "
         "|| cast(year as varchar)), 1, 13))::bigint)")
    ranked = f"""
rep{suf} as (select fa.*, rr.r from fa, range(1, {R_PLACEBO + 1}) rr(r)),
rk{suf} as (select *, row_number() over (partition by r order by {h}, firm_id, year) rank from rep{suf}),"""
    if moved == "t":
        perm = f"perm{suf} as (select * exclude (t), (rank <= (select sum(t) from fa))::int t from rk{suf})"
    else:
        perm = f"""slots{suf} as (select t, hs, count(*) c, sum(count(*)) over (order by t desc, hs nulls first) upto from fa group by t, hs),
perm{suf} as (select k.r, k.y, s.t, s.hs from rk{suf} k join slots{suf} s on k.rank <= s.upto and k.rank > s.upto - s.c)"""
    return ranked + perm + "," + _cell_sql(f"perm{suf}", ["r"], ["hs"], name=f"sc{suf}") + "," + _aipw_sql(
        f"sc{suf}", ["r"], name=f"est{suf}")


def _placebo_spark(spark, sf_dir, which):
    d = firm_analysis(spark, sf_dir).select("firm_id", "year", "t", "y", "hs")
    return RS.placebo(d, "t", "y", ["hs"], ["firm_id", "year"], R=R_PLACEBO, permute=which, seed=42)


@register("placebo_treatment", FA(_est_cols("r"), _perm_sql("t")))
def q_placebo_t(spark, sf_dir):
    """#94: treatment permuted within each of 200 replicates; AIPW per replicate."""
    return rounded(_placebo_spark(spark, sf_dir, "treatment").select("r", *EST), EFF)


@register("placebo_outcome", FA(_est_cols("r"), _perm_sql("y")))
def q_placebo_y(spark, sf_dir):
    """#95: outcome permuted within each replicate."""
    return rounded(_placebo_spark(spark, sf_dir, "outcome").select("r", *EST), EFF)


_PLACEBO_LINE = """
rg{s} as (select r, count(*) n, sum(t) n_treated, var_pop(t) * count(*) stt, var_pop(region) * count(*) sxx, covar_pop(t, region) * count(*) stx,
           covar_pop(t, y) * count(*) sty, covar_pop(region, y) * count(*) sxy, var_pop(y) * count(*) syy from perm{s} group by r),
rc{s} as (select *, stt * sxx - stx * stx det, (sty * sxx - sxy * stx) / (stt * sxx - stx * stx) bt,
           (sxy * stt - sty * stx) / (stt * sxx - stx * stx) bx from rg{s}),
lest{s} as (select r, n, n_treated, 100.0 * n_treated / n treated_pct, bt ate, sqrt((syy - bt * sty - bx * sxy) / (n - 3) * sxx / det) se from rc{s})"""


@register("placebo_regression", FA(_est_cols("r", "lest"), _perm_sql("t") + "," + _PLACEBO_LINE.format(s="")))
def q_placebo_regression(spark, sf_dir):
    """#94 with linear adjustment: the covariates' cross products are fixed, a
    replicate is the sum of its treated rows."""
    d = firm_analysis(spark, sf_dir).withColumn("region", F.col("region").cast("double"))
    res = RS.placebo_regression(d, "t", "y", ["region"], ["firm_id", "year"], R=R_PLACEBO, seed=42)
    return rounded(res.select("r", *EST), EFF)


def _placebo_summary_sql() -> str:
    real = _cell_sql("fa", [], ["hs"], name="rs") + "," + _aipw_sql("rs", [], name="rest")
    return _perm_sql("t", "_t") + "," + _perm_sql("y", "_y") + "," + real


@register("placebo_summary", FA("""
select test, round(ate, 6) ate, round(spread, 6) spread, n_iter::bigint n_iter,
  case when test = 'real' then null else (abs(ate) < 2 * spread)::int end near_zero,
  case when test = 'real' then null else round((select ate from rest) / ate, 4) end ratio,
  round(spread / sqrt(n_iter), 6) se_of_mean
from (select 'real' test, ate, se spread, 1 n_iter from rest
      union all select 'random_treatment', avg(ate), stddev_pop(ate), count(*) from est_t
      union all select 'permuted_outcome', avg(ate), stddev_pop(ate), count(*) from est_y) u""", _placebo_summary_sql()))
def q_placebo_summary(spark, sf_dir):
    """#96: real estimate (computed, not a constant) against both placebo
    families."""
    d = firm_analysis(spark, sf_dir).select("firm_id", "year", "t", "y", "hs")
    real = E.cell_aipw(d, "t", "y", ["hs"])
    tr = RS.placebo(d, "t", "y", ["hs"], ["firm_id", "year"], R=R_PLACEBO, permute="treatment", seed=42)
    yr = RS.placebo(d, "t", "y", ["hs"], ["firm_id", "year"], R=R_PLACEBO, permute="outcome", seed=42)
    s = RS.placebo_summary(real, tr, yr)
    return rounded(s, {"ate": 6, "spread": 6, "ratio": 4, "se_of_mean": 6})


# --------------------------------------------------------- #97-#100
_DOSE_SQL = """
ed as (select list_sort(list_distinct(quantile_cont(dti_mean, [0.0, 0.25, 0.5, 0.75, 1.0]))) e from fa where t = 1),
bn as (select fa.*, len(e) - 1 nb,
         case when t = 1 and dti_mean is not null and dti_mean >= e[1] and dti_mean <= e[len(e)]
              then greatest(""" + " + ".join(
    f"coalesce((dti_mean > e[{i + 1}])::int, 0)" for i in range(5)) + """, 1) - 1 end bin
       from fa, ed),
rows as (select bn.*, tb.tbin, (t = 1 and bin = tb.tbin)::int t_bin from bn, unnest(range(0, nb)) tb(tbin)),
""" + _cell_sql("rows", ["tbin"], ["hs"], t="t_bin").lstrip() + "," + _aipw_sql("sc", ["tbin"], t="t_bin")


@register("dose_response", FA(_est_cols("tbin as bin").replace("from (select *", "from (select *") +
                              " where n_treated >= 100", _DOSE_SQL))
def q_dose(spark, sf_dir):
    """#97: quartile bins of the adoption intensity among treated rows (equal
    edges dropped); per bin AIPW of "in this bin" against all other rows."""
    d = firm_analysis(spark, sf_dir)
    res = HT.dose_response(d, "t", "dti_mean", "y", ["hs"], q=4, labels=None, min_treated=100, std_min=0.2)
    return rounded(res.select("bin", *EST), EFF)


_IND_SQL = """
top as (select industry_2digit from fa group by industry_2digit having count(*) >= 300
        order by count(*) desc, industry_2digit limit 5),
sub as (select * from fa where industry_2digit in (select industry_2digit from top)),
""" + _cell_sql("sub", ["industry_2digit"], ["hs"]).lstrip() + "," + _aipw_sql("sc", ["industry_2digit"])


@register("effect_by_industry", FA(_est_cols("industry_2digit"), _IND_SQL))
def q_industry(spark, sf_dir):
    """#99: AIPW for the five largest industries (at least 300 rows)."""
    res = HT.effect_by_industry(firm_analysis(spark, sf_dir), "t", "y", ["hs", "industry_2digit"],
                                "industry_2digit", top=5, min_rows=300)
    return rounded(res.select("industry_2digit", *EST), EFF)


_PERIODS = ("Early (1995)", "Middle (1996-1997)", "Late (1998-2001)")
_PERIOD_YEARS = ((1995,), (1996, 1997), (1998, 1999, 2000, 2001))
_PER_SQL = f"""
pe as (select *, case when year in (1996, 1997) then '{_PERIODS[1]}' when year in (1998, 1999, 2000, 2001)
                      then '{_PERIODS[2]}' else '{_PERIODS[0]}' end period from fa),
""" + _cell_sql("pe", ["period"], ["hs", "region"]).lstrip() + "," + _aipw_sql("sc", ["period"]).replace(
    "group by period)", "group by period having count(*) >= 500)")


@register("effect_by_period_firms", FA(_est_cols("period"), _PER_SQL))
def q_period_firms(spark, sf_dir):
    """#98 on the firm panel: labelled periods, 500-row gate."""
    res = HT.effect_by_period(firm_analysis(spark, sf_dir), "t", "y", ["hs", "region"], labels=_PERIODS,
                              years=_PERIOD_YEARS, min_rows=500)
    return rounded(res.select("period", *EST), EFF)


_CMP_SQL = (_cell_sql("base", [], ["segment", "region"]) + "," + _aipw_sql("sc", [], name="a_est") + "," +
            _cell_sql("base", [], ["segment", "region"], clip=False, name="tc") + """,
gq as (select *, least(greatest(ps, 0.01), 0.99) g from tc),
ep as (select sum((t / g - (1 - t) / (1 - g)) * (y - (t * mu1 + (1 - t) * mu0)))
          / sum((t / g - (1 - t) / (1 - g)) * (t / g - (1 - t) / (1 - g))) epsilon from gq),
st as (select gq.*, mu1 + epsilon / g m1s, mu0 - epsilon / (1 - g) m0s from gq, ep),
t_est as (select count(*) n, avg(m1s - m0s) ate,
          sqrt(var_pop(t / g * (y - m1s) - (1 - t) / (1 - g) * (y - m0s) + m1s - m0s) / count(*)) se from st),
rg as (select count(*) n, var_pop(t) * count(*) stt, var_pop(region) * count(*) sxx,
         covar_pop(t, region) * count(*) stx, covar_pop(t, y) * count(*) sty, covar_pop(region, y) * count(*) sxy,
         var_pop(y) * count(*) syy from base),
rc as (select *, stt * sxx - stx * stx det, (sty * sxx - sxy * stx) / (stt * sxx - stx * stx) bt,
         (sxy * stt - sty * stx) / (stt * sxx - stx * stx) bx from rg),
r_est as (select n, bt ate, sqrt((syy - bt * sty - bx * sxy) / (n - 3) * sxx / det) se from rc),
est as (select 'aipw' method, n, ate, se from a_est union all select 'tmle', n, ate, se from t_est
        union all select 'regression', n, ate, se from r_est)""")


@register("method_comparison", O(f"""select method, n::bigint n, {S.r('ate')} ate, {S.r('se')} se,
  {S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper, {S.r('z', 4)} z, {S.r('p_value', 4)} p_value,
  {S.r('effect_pct', 4)} effect_pct from (select *, {S.finish()} from est) e""", _CMP_SQL))
def q_methods(spark, sf_dir):
    """#100: AIPW, TMLE and regression side by side on the order panel."""
    d = order_panel(spark, sf_dir).withColumn("region", F.col("region").cast("double"))
    return rounded(HT.method_comparison(d, "t", "y", ["segment", "region"], ["region"]), EFF)


# ---------------------------------------------------------------- #101
def _u(tag: str) -> str:
    return (f"((('0x' || substr(md5('7:{tag}:' || cast(firm_id as varchar) || ':' || cast(year as varchar)), 1, 13))"
            f"::bigint::double + 0.5) / 4503599627370496.0::double)")


_AMP_COLS = ["dti_mean", "hs", "region", "total_debt", "rd_employees_total", "direct_export_amount"]
_AMP_FREE = [(j, c) for j, c in enumerate(_AMP_COLS) if c != "region"]
_A0 = -__import__("math").log((1 - 0.3) / 0.3)


def _h(tag: str) -> str:
    return (f"(('0x' || substr(md5('7:{tag}:' || cast(firm_id as varchar) || ':' || cast(year as varchar)), 1, 13))::bigint)")


def _first(j: int) -> str:
    """How many other columns come before column j in a row's order of hashes."""
    return " + ".join(f"({_h(f'col{i}')} < {_h(f'col{j}')})::int" for i, _ in _AMP_FREE if i != j)


_AMP_SQL = f"""
mn as (select {', '.join((f"case when {_u(f'cell{j}')} < 1 / (1 + exp(-({repr(_A0)} + 0.5 * {c}))) then null else {c} end {c}"
                            if c != "region" else c) for j, c in enumerate(_AMP_COLS))} from fa),
st as (select avg(y) ym, stddev_samp(y) ys, avg(region) xm, stddev_samp(region) xs, count(*) n from fa),
sr as (select fa.*, n, ln({_u('row')}) / (1 / (1 + exp(-(-1 + 0.3 * (y - ym) / ys + 0.3 * (region - xm) / xs)))) score
       from fa, st),
rk as (select *, row_number() over (order by -score, firm_id, year) rk, 1 + floor({_u('count')} * 3)::int many from sr),
ma as (select rk <= round(0.3 * n) chosen, many, {', '.join(
    (f"case when rk <= round(0.3 * n) and {_first(j)} < many then null else {c} end {c}" if c != "region" else c)
    for j, c in enumerate(_AMP_COLS))} from rk)"""


@register("ampute", FA(" union all ".join(
    [f"select 'MNAR' mechanism, '{c}' variable, (count(*) - count({c}))::bigint n_missing from mn" for c in _AMP_COLS]
    + [f"select 'MAR' mechanism, '{c}' variable, (count(*) - count({c}))::bigint n_missing from ma" for c in _AMP_COLS]),
    _AMP_SQL))
def q_ampute(spark, sf_dir):
    """#101: MNAR (cell chance from the value) and MAR (rows chosen by
    outcome and first covariate, exactly round(.3 n) rows, a drawn number of
    1 to 3 of the 5 other columns blanked) on a real table; md5 draws."""
    d = firm_analysis(spark, sf_dir)
    mn = RS.ampute(d, _AMP_COLS, 0.3, "MNAR", ["firm_id", "year"], seed=7, x0="region")
    ma = RS.ampute(d, _AMP_COLS, 0.3, "MAR", ["firm_id", "year"], seed=7, y="y", x0="region")
    parts = []
    for name, t in (("MNAR", mn), ("MAR", ma)):
        one = t.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _AMP_COLS])
        structs = [F.struct(F.lit(name).alias("mechanism"), F.lit(c).alias("variable"), F.col(c).alias("n_missing"))
                   for c in _AMP_COLS]
        parts.append(one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*"))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------ #71-#76
_IMP_COLS = ["total_debt", "rd_employees_total", "direct_export_amount"]


@register("impute_median", FA(", ".join(
    [f"select round(avg(coalesce({c}, (select median({c}) from fa))), 4) {c}" if i == 0 else
     f"round(avg(coalesce({c}, (select median({c}) from fa))), 4) {c}" for i, c in enumerate(_IMP_COLS)]) + " from fa"))
def q_impute_median(spark, sf_dir):
    d = IM.impute_median(firm_analysis(spark, sf_dir), _IMP_COLS)
    return d.agg(*[F.round(F.avg(c), 4).alias(c) for c in _IMP_COLS])


@register("impute_mean", FA("select " + ", ".join(
    f"round(avg(coalesce({c}, (select avg({c}) from fa))), 4) {c}, count(coalesce({c}, (select avg({c}) from fa)))::bigint n_{c}"
    for c in _IMP_COLS) + " from fa"))
def q_impute_mean(spark, sf_dir):
    d = IM.impute_mean(firm_analysis(spark, sf_dir), _IMP_COLS)
    return d.agg(*[x for c in _IMP_COLS for x in (F.round(F.avg(c), 4).alias(c), F.count(c).alias(f"n_{c}"))])


_DROP_COLS = ["negative_revenue", "total_debt", "direct_export_amount", "rd_employees_total"]


@register("drop_all_missing_columns", S.with_panel(CLEAN_SQL.strip() + """,
sub as (select case when revenue < 0 then revenue end negative_revenue, total_debt, direct_export_amount,
          rd_employees_total from clean)""", " union all ".join(
    f"select '{c}' variable, (count({c}) = 0)::int dropped, count({c})::bigint n_present from sub" for c in _DROP_COLS)))
def q_drop_all_missing(spark, sf_dir):
    """#73 over the whole table: a derived column that never holds a value
    (revenue below zero) leaves the table, partly missing columns stay."""
    sub = clean_firm_panel(spark, sf_dir).select(
        F.when(F.col("revenue") < 0, F.col("revenue")).alias("negative_revenue"), "total_debt",
        "direct_export_amount", "rd_employees_total")
    kept, dropped = IM.drop_all_missing_columns(sub, _DROP_COLS)
    one = sub.agg(*[F.count(c).alias(c) for c in _DROP_COLS])
    structs = [F.struct(F.lit(c).alias("variable"), F.lit(int(c in dropped)).alias("dropped"),
                        F.col(c).alias("n_present")) for c in _DROP_COLS]
    return one.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


@register("stack_imputations", FA("""select m, count(*)::bigint n, count(total_debt)::bigint n_debt
  from fa, range(1, 6) mm(m) group by m"""))
def q_stack(spark, sf_dir):
    d = IM.stack_imputations(firm_analysis(spark, sf_dir), 5)
    return d.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.count("total_debt").alias("n_debt"))


def _imputed_sql(m: int, cols: list[str]) -> str:
    sums = ", ".join(f"0::bigint missing_{c}, round((select avg({c}) from fa), 4) observed_{c}, 0::bigint changed_{c}, 1 drawn_{c}" for c in cols)
    return FA(f"select m, (select count(*) from fa)::bigint n, {sums} from range(1, {m + 1}) mm(m)")


def _imputed_check(imp, before, cols, inside):
    """Per m: rows, missing cells left, the mean of the observed cells and how
    many of them changed, and whether the filled cells vary (and, with
    ``inside``, stay in the observed range)."""
    keys = ["firm_id", "year"]
    span = before.agg(*[x for c in cols for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    j = imp.join(before.select(*keys, *[F.col(c).alias(f"o_{c}") for c in cols]), keys).crossJoin(F.broadcast(span))
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        was = F.col(f"o_{c}").isNotNull()
        filled = F.when(~was, F.col(c))
        good = F.stddev_pop(filled) > 0
        if inside:
            good = good & (F.min(filled) >= F.max(f"lo_{c}")) & (F.max(filled) <= F.max(f"hi_{c}"))
        aggs += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}"), F.round(F.avg(F.when(was, F.col(c))), 4).alias(f"observed_{c}"),
                 F.count_if(was & (F.col(c) != F.col(f"o_{c}"))).alias(f"changed_{c}"), good.cast("int").alias(f"drawn_{c}")]
    return j.groupBy("m").agg(*aggs)


@register("impute_chained", _imputed_sql(5, _IMP_COLS))
def q_impute_chained(spark, sf_dir):
    """#75: Bayesian chained imputation, M = 5, 5 sweeps, outcome as extra
    predictor; no cell stays missing, observed cells stay, drawn cells vary."""
    d = cut_lineage(firm_analysis(spark, sf_dir))
    imp = IM.impute_chained(d, _IMP_COLS, M=5, max_iter=5, extra_predictors=["y"], row_key=["firm_id", "year"],
                            seed=1)
    return _imputed_check(imp, d, _IMP_COLS, False)


@register("impute_forest", _imputed_sql(2, _IMP_COLS))
def q_impute_forest(spark, sf_dir):
    """#74: forest chain (10 trees, depth 5), M = 2, 2 sweeps; a forest fills
    within the observed range."""
    d = cut_lineage(firm_analysis(spark, sf_dir))
    imp = IM.impute_chained(d, _IMP_COLS, M=2, max_iter=2, learner="forest", extra_predictors=["y"],
                            row_key=["firm_id", "year"], seed=42)
    return _imputed_check(imp, d, _IMP_COLS, True)


def _pool_check(res):
    """Rubin's rules hold and the imputations differ."""
    infl = F.lit(1.0) + F.lit(1.0) / F.col("M")
    return res.select("M", (F.col("B") > 0).cast("int").alias("imputations_differ"),
                      (F.abs(F.col("total_var") / (F.col("W") + infl * F.col("B")) - 1) < 1e-12).cast("int").alias("total_is_within_and_between"),
                      (F.abs(F.col("se") * F.col("se") / F.col("total_var") - 1) < 1e-12).cast("int").alias("se_is_root"),
                      (F.col("B") < F.col("W")).cast("int").alias("between_below_within"))


_POOL_CHECK = "select 5::bigint \"M\", 1 imputations_differ, 1 total_is_within_and_between, 1 se_is_root, 1 between_below_within"


@register("effect_imputed_dr", _POOL_CHECK)
def q_imputed_dr(spark, sf_dir):
    """#92: Bayesian chained imputation, cross-fitted AIPW per m with linear
    nuisances on the covariates, Rubin pooling (normal form)."""
    d = firm_analysis(spark, sf_dir)
    return _pool_check(HT.effect_imputed_dr(d, "t", "y", _IMP_COLS[:2], ["firm_id", "year"], M=5, max_iter=3, learner="linear"))


@register("imputed_outcome_effect", S.with_panel(CLEAN_SQL.strip(), """
select m, count(*)::bigint n, sum(dti_binary)::bigint n_treated, 1 between_zero_and_one, 1 se_positive from clean, range(1, 4) mm(m) group by m"""))
def q_imputed_outcome_effect(spark, sf_dir):
    """The whole study: chained imputation (#75), production outcome per
    imputation (#79, #80), cross-fitted AIPW per imputation with a logistic
    propensity (#81, #89); rows and treated of every imputation, pooled share
    of the between variance (#91)."""
    d = clean_firm_panel(spark, sf_dir).select("firm_id", "year", "dti_binary", "revenue", "capital", "employees", "materials", "energy", "total_debt",
                                               "rd_employees_total", "region")
    imp = IM.impute_chained(d, ["total_debt", "rd_employees_total"], M=3, max_iter=2, extra_predictors=["revenue"], row_key=["firm_id", "year"], seed=3)
    logs = imp.withColumns({c: F.ln(F.greatest(F.col(c), F.lit(1.0))) for c in ("total_debt", "rd_employees_total")})
    rows, _ = PD.add_outcomes(logs, by=["m"])
    per = RS.crossfit_aipw(rows, "dti_binary", "tfp_lp", ["total_debt", "rd_employees_total", "region"], ["firm_id", "year"], ["m"], learner="logistic")
    per = cut_lineage(per.select("m", "n", "n_treated", "ate", "se"))
    pooled = E.pool_rubin(per, [], reference="z")
    share = F.try_divide((1 + 1 / F.col("M")) * F.col("B"), F.col("total_var"))
    return per.crossJoin(F.broadcast(pooled.select((share > 0).alias("_some"), (share < 1).alias("_part")))).select(
        "m", "n", "n_treated", (F.col("_some") & F.col("_part")).cast("int").alias("between_zero_and_one"), (F.col("se") > 0).cast("int").alias("se_positive"))


_CC_SQL = """
cc as (select * from fa where total_debt is not null and rd_employees_total is not null),
cc2 as (select * from cc where (select count(*) >= 100 from cc)),"""


def _crossfit_bins_sql(src: str) -> str:
    fold = ("(('0x' || substr(md5('42:' || cast(firm_id as varchar) || ':' || cast(year as varchar)), 1, 13))"
            "::bigint % 5)")
    return f"""
ed as (select quantile_cont(total_debt, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) qd,
         quantile_cont(rd_employees_total, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) qr from {src}),
d as (select s.*, {fold} fold,
        (total_debt >= qd[2])::int + (total_debt >= qd[3])::int + (total_debt >= qd[4])::int + (total_debt >= qd[5])::int bd,
        (rd_employees_total >= qr[2])::int + (rd_employees_total >= qr[3])::int + (rd_employees_total >= qr[4])::int
        + (rd_employees_total >= qr[5])::int br from {src} s, ed),
cf as (select fold, bd, br, count(*) c, sum(t) n1, coalesce(sum(case when t = 1 then y end), 0) s1,
        coalesce(sum(case when t = 0 then y end), 0) s0 from d group by all),
ct as (select bd, br, sum(c) c_all, sum(n1) n1_all, sum(s1) s1_all, sum(s0) s0_all from cf group by all),
gf as (select fold, sum(c) gc, sum(n1) gn1, sum(s1) gs1, sum(s0) gs0 from cf group by all),
gt as (select sum(c) gc_all, sum(n1) gn1_all, sum(s1) gs1_all, sum(s0) gs0_all from cf),
tab as (select cf.*, c_all - c cc_, n1_all - n1 n1c, s1_all - s1 s1c, s0_all - s0 s0c,
          gc_all - gc gcc, gn1_all - gn1 gn1c, gs1_all - gs1 gs1c, gs0_all - gs0 gs0c
        from cf join ct using (bd, br) join gf using (fold), gt),
nu0 as (select *, case when gn1c > 0 then gs1c / gn1c else 0 end gmu1,
          case when gcc - gn1c > 0 then gs0c / (gcc - gn1c) else 0 end gmu0 from tab),
nu as (select fold, bd, br,
          least(greatest(case when cc_ > 0 then n1c / cc_ when gcc > 0 then gn1c / gcc end, 0.01), 0.99) ps,
          case when gn1c > 10 then (case when n1c > 0 then s1c / n1c else gmu1 end) else gmu1 end mu1,
          case when gcc - gn1c > 10 then (case when cc_ - n1c > 0 then s0c / (cc_ - n1c) else gmu0 end) else gmu0 end mu0
        from nu0),
sc as (select d.*, mu1 - mu0 + t / ps * (y - mu1) - (1 - t) / (1 - ps) * (y - mu0) psi
       from d join nu using (fold, bd, br)),
est as (select count(psi) n, sum(t) n_treated, 100.0 * sum(t) / count(psi) treated_pct, avg(psi) ate,
        sqrt(var_samp(psi) / count(psi)) se from sc)"""


@register("effect_complete_case", FA(_est_cols(), _CC_SQL + _crossfit_bins_sql("cc2")))
def q_complete_case(spark, sf_dir):
    """#92b: complete cases, coarsened covariates, 5-fold cross-fitted AIPW."""
    res = HT.effect_complete_case(firm_analysis(spark, sf_dir), "t", "y", ["total_debt", "rd_employees_total"],
                                  ["firm_id", "year"])
    return rounded(res.select(*EST), EFF)


def _linear_bins(src: str) -> str:
    fold = ("(('0x' || substr(md5('42:' || cast(firm_id as varchar) || ':' || cast(year as varchar)), 1, 13))"
            "::bigint % 5)")
    return f"""
d as (select *, {fold} fold from {src}),{_fold_lines_sql('d', 'year', 'total_debt')},
sc as (select *, mu1 - mu0 + t / ps * (y - mu1) - (1 - t) / (1 - ps) * (y - mu0) psi from fit),
est as (select year, count(*) n, sum(t) n_treated, 100.0 * sum(t) / count(*) treated_pct, avg(psi) ate,
          sqrt(var_samp(psi) / count(*)) se from sc group by year)"""


@register("complete_case_linear", FA(_est_cols("year"), """
cc as (select * from fa where total_debt is not null),
cc2 as (select * from cc where year in (select year from cc group by year having count(*) >= 100)),""" + _linear_bins("cc2")))
def q_complete_case_linear(spark, sf_dir):
    """#92b on a continuous covariate: cross-fitted AIPW with linear nuisances per year."""
    res = HT.effect_complete_case(firm_analysis(spark, sf_dir), "t", "y", ["total_debt"], ["firm_id", "year"], ["year"], learner="linear")
    return rounded(res.select("year", *EST), EFF)


@register("single_imputation_linear", FA(_est_cols("year"), """
mi as (select fa.* replace (coalesce(total_debt, (select avg(g.total_debt) from fa g where g.year = fa.year)) as total_debt) from fa),""" + _linear_bins("mi")))
def q_single_imputation_linear(spark, sf_dir):
    """#92c on a continuous covariate: mean imputation per year, then the same."""
    res = HT.effect_single_imputation(firm_analysis(spark, sf_dir), "t", "y", ["total_debt"], ["firm_id", "year"], ["year"], learner="linear")
    return rounded(res.select("year", *EST), EFF)


@register("effect_single_imputation", FA(_est_cols(), """
mi as (select * replace (coalesce(total_debt, (select avg(total_debt) from fa)) as total_debt,
         coalesce(rd_employees_total, (select avg(rd_employees_total) from fa)) as rd_employees_total) from fa),"""
                                         + _crossfit_bins_sql("mi")))
def q_single_imputation(spark, sf_dir):
    """#92c: mean imputation, coarsened covariates, cross-fitted AIPW."""
    res = HT.effect_single_imputation(firm_analysis(spark, sf_dir), "t", "y", ["total_debt", "rd_employees_total"],
                                      ["firm_id", "year"])
    return rounded(res.select(*EST), EFF)


@register("imputed_effect_pooled", FA(f"""select 3::bigint "M", {S.r('ate')} ate, {S.r('se')} se, {S.r('ci_lower')} ci_lower,
  {S.r('ci_upper')} ci_upper, {S.r('p_value', 4)} p_value from (select *, {S.finish()} from est) e""", """
mi as (select * replace (coalesce(total_debt, (select avg(total_debt) from fa)) as total_debt,
         coalesce(rd_employees_total, (select avg(rd_employees_total) from fa)) as rd_employees_total) from fa),"""
                                      + _crossfit_bins_sql("mi")))
def q_imputed_pooled(spark, sf_dir):
    """Impute, estimate per imputation, pool: three mean-imputed copies (equal
    copies have no between-imputation variance), cross-fitted AIPW per m."""
    xs = ["total_debt", "rd_employees_total"]
    copies = IM.stack_imputations(IM.impute_mean(firm_analysis(spark, sf_dir), xs), 3)
    binned = HT.coarsen(copies, xs, 5, ["m"])
    res = HT.effect_over_imputations(binned, lambda d, by: RS.crossfit_cell_aipw(
        d, "t", "y", [f"{x}_bin" for x in xs], ["firm_id", "year"], by))
    return rounded(res.select("M", "ate", "se", "ci_lower", "ci_upper", "p_value"), EFF)


@register("imputed_regression_pooled", FA(f"""select "M"::bigint "M", {S.r('ate')} ate, {S.r('se')} se, {S.r('B', 10)} b_var,
  {S.r('p_value', 4)} p_value from (select *, {S.finish()} from pooled) e""", """
imp as (select 1 m, t, y, coalesce(total_debt, (select avg(total_debt) from fa)) x from fa
        union all select 2, t, y, coalesce(total_debt, (select median(total_debt) from fa)) from fa),
rg as (select m, count(*) n, var_pop(t) * count(*) stt, var_pop(x) * count(*) sxx, covar_pop(t, x) * count(*) stx,
         covar_pop(t, y) * count(*) sty, covar_pop(x, y) * count(*) sxy, var_pop(y) * count(*) syy from imp group by m),
rc as (select *, stt * sxx - stx * stx det, (sty * sxx - sxy * stx) / (stt * sxx - stx * stx) bt,
         (sxy * stt - sty * stx) / (stt * sxx - stx * stx) bx from rg),
est as (select m, bt ate, sqrt((syy - bt * sty - bx * sxy) / (n - 3) * sxx / det) se from rc),
pr as (select count(*) "M", avg(ate) ate, avg(se * se) w, var_samp(ate) "B" from est),
pooled as (select *, sqrt(w + 1.5 * "B") se from pr)"""))
def q_imputed_regression(spark, sf_dir):
    """#92d after imputation: regression per imputation (mean and median
    filled), pooled by Rubin's rules."""
    fa = firm_analysis(spark, sf_dir).select("t", "y", "total_debt")
    filled = [IM.impute_mean(fa, ["total_debt"]), IM.impute_median(fa, ["total_debt"])]
    both = filled[0].withColumn("m", F.lit(1)).unionByName(filled[1].withColumn("m", F.lit(2)))
    res = HT.effect_over_imputations(both, lambda d, by: HT.effect_regression(d, "t", "y", ["total_debt"], by=by))
    return rounded(res.select("M", "ate", "se", F.col("B").alias("b_var"), "p_value"), {**EFF, "b_var": 10})


_EVAL_SQL = _cell_sql("fa", ["industry_2digit"], ["hs"]) + "," + _aipw_sql("sc", ["industry_2digit"]) + """,
sz as (select industry_2digit, count(*) n_rows, sum(t) n1 from fa group by industry_2digit),
gated as (select s.industry_2digit, n_rows < 100 or n1 = 0 or n1 = n_rows bad, ate, se from sz s left join est using (industry_2digit)),
runs as (select method, case when not bad and not (method = 'fragile' and industry_2digit = 7) then ate end ate,
           case when not bad and not (method = 'fragile' and industry_2digit = 7) then se end se from gated, (values ('cell_aipw'), ('fragile')) v(method))"""


@register("evaluate_methods", FA("""select method, count(*)::bigint runs, (count(*) - count(ate))::bigint errors, round(avg(ate), 6) bias_mean,
  round(avg(case when ate is not null then (ate - 1.96 * se <= 0 and ate + 1.96 * se >= 0)::int end), 6) coverage from runs group by method""", _EVAL_SQL))
def q_evaluate(spark, sf_dir):
    """#102: two methods on every industry dataset of the firm panel; gates
    become error rows, and the method that fails on one industry fails on that
    one alone; run metrics per method."""
    d = cut_lineage(firm_analysis(spark, sf_dir))

    def fragile(df, by):
        broken = F.when(F.col("industry_2digit") == 7, F.raise_error(F.lit("no estimate for this industry")).cast("double"))
        return E.cell_aipw(df.withColumn("y", F.coalesce(broken, F.col("y"))), "t", "y", ["hs"], by=by)

    runs = HT.evaluate_methods(d, {"cell_aipw": lambda df, by: E.cell_aipw(df, "t", "y", ["hs"], by=by), "fragile": fragile},
                               ["industry_2digit"], truth=0.0, min_rows=100, t="t")
    ok = F.col("error").isNull()
    return runs.groupBy("method").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("errors"), F.round(F.avg("bias"), 6).alias("bias_mean"),
                                      F.round(F.avg(F.when(ok, F.col("coverage"))), 6).alias("coverage"))


# ------------------------------------------------------- fitted learners
_LOGIT_SQL = "select year, count(*)::bigint n, sum(t)::bigint n_treated, round(avg(t), 6) ps_mean, 1 inside, 1 score_hs, 1 score_region, 1 converged from fa group by year"


def _scores(p, coefs, xs, penalty, by):
    """Mean and range of the probabilities and the score equations X'(T - p) = penalty x b (to 1e-6)."""
    d = join_on_keys(p, coefs.select(*by, "coef", "converged", penalty.alias("_lam")), by, "left")
    sums = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").cast("long").alias("n_treated"), F.round(F.avg("ps"), 6).alias("ps_mean"),
        ((F.min("ps") > 0) & (F.max("ps") < 1)).cast("int").alias("inside"),
        *[(F.abs(F.sum((F.col("t") - F.col("ps")) * F.col(x)) - F.first("_lam") * F.first(F.get("coef", F.lit(i + 1)))) < 1e-6).cast("int").alias(f"score_{x}")
          for i, x in enumerate(xs)], F.first("converged").cast("int").alias("converged"))
    return sums


@register("propensity_logistic", FA(_LOGIT_SQL))
def q_logistic_by_year(spark, sf_dir):
    """#83 'logistic' with a fixed penalty, all years in the same Newton steps."""
    d = cut_lineage(firm_analysis(spark, sf_dir))
    coefs = LG.logistic_fit(d, "t", ["hs", "region"], ["year"], 1.0)
    return _scores(LG.logistic_predict(d, coefs, ["hs", "region"], ["year"]), coefs, ["hs", "region"], F.lit(1.0), ["year"])


@register("propensity_logistic_cv", FA(_LOGIT_SQL.replace("year, ", "", 1).replace(" group by year", "")))
def q_logistic(spark, sf_dir):
    """#81: L2 logistic propensity with 5-fold choice of the penalty over 10
    values, all 50 fits in the same Newton steps."""
    d = cut_lineage(RS.fold_assign(firm_analysis(spark, sf_dir), 5, 42, ["firm_id", "year"], "fold"))
    coefs = LG.logistic_cv(d, "t", ["hs", "region"])
    return _scores(LG.logistic_predict(d, coefs, ["hs", "region"]), coefs, ["hs", "region"], F.col("penalty"), [])


@register("propensity_ensemble", FA("select year, count(*)::bigint n, count(*)::bigint n_inside, 1 between_members from fa group by year"))
def q_ensemble(spark, sf_dir):
    """#83 'ensemble': mean of the cross-validated logistic and the boosted propensity (40 trees here)."""
    d = cut_lineage(firm_analysis(spark, sf_dir))
    xs = ["hs", "region", "industry_2digit"]
    p = LN.propensity(d, "t", xs, "ensemble", key=["firm_id", "year"], trees=40)
    p = LN.propensity(LN.propensity(p, "t", xs, "logistic", out="a", key=["firm_id", "year"]), "t", xs, "gbm", out="b", trees=40)
    between = F.col("ps").between(F.least("a", "b") - 1e-12, F.greatest("a", "b") + 1e-12)
    return p.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ps") > 0) & (F.col("ps") < 1)).alias("n_inside"),
                                 F.min(between.cast("int")).alias("between_members"))


@register("gbt_aipw_by_period", FA("""select period, count(*)::bigint n, sum(t)::bigint n_treated, round(avg(case when t = 1 then y end), 6) mu1_own_mean,
  round(avg(case when t = 0 then y end), 6) mu0_own_mean, 1 ps_inside, 1 se_positive from pe group by period""", _PER_SQL.split("),\n")[0].strip().lstrip(",") + ")"))
def q_gbt(spark, sf_dir):
    """#82-#84 + #88: boosted propensity and arm outcome models (50 trees,
    depth 3 as in the split analyses) of all periods at once, AIPW per period.
    Boosting of squared errors keeps the mean of an arm's own rows."""
    d = firm_analysis(spark, sf_dir).withColumn("period", X.period_label("year", _PERIODS, _PERIOD_YEARS))
    d = cut_lineage(d.withColumns({c: F.col(c).cast("double") for c in ("t", "region")}))
    d = LN.nuisances(d, "t", "y", ["hs", "region", "industry_2digit"], "gbt", ["period"], trees=50, depth=3, min_leaf=1)
    d = cut_lineage(d)
    own = d.groupBy("period").agg(*[F.round(F.avg(F.when(F.col("t") == a, F.col(f"mu{a}"))), 6).alias(f"mu{a}_own_mean") for a in (1, 0)],
                                  ((F.min("ps") >= 0.01) & (F.max("ps") <= 0.99)).cast("int").alias("ps_inside"))
    est = E.aipw_effect(d, "t", "y", by=["period"]).select("period", "n", "n_treated", (F.col("se") > 0).cast("int").alias("se_positive"))
    return est.join(own, "period")


# ------------------------------------------------------- linear learner
_LIN_SQL = """
bl as (select *, cast(region as double) x from base),
c1 as (select year, regr_intercept(t, x) a_t, regr_slope(t, x) b_t from bl group by year),
c2 as (select year, regr_intercept(y, x) a_1, regr_slope(y, x) b_1 from bl where t = 1 group by year),
c3 as (select year, regr_intercept(y, x) a_0, regr_slope(y, x) b_0 from bl where t = 0 group by year),
sc as (select bl.*, least(greatest(a_t + b_t * x, 0.01), 0.99) ps, a_1 + b_1 * x mu1, a_0 + b_0 * x mu0
       from bl join c1 using (year) join c2 using (year) join c3 using (year)),""" + _aipw_sql("sc", ["year"])


@register("aipw_linear", O(_est_cols("year"), _LIN_SQL))
def q_aipw_linear(spark, sf_dir):
    """#83/#84 with the ``linear`` learner: linear-probability propensity and
    per-arm least-squares outcome models (one regressor) per year: all
    three designs and all years from one grouped aggregation; clipped ps."""
    from ..operators.learners import linear_nuisances
    d = order_panel(spark, sf_dir).withColumn("x", F.col("region").cast("double"))
    d = linear_nuisances(d, "t", "y", ["x"], by=["year"])
    return rounded(E.aipw_effect(d, "t", "y", by=["year"]).select("year", *EST), EFF)
