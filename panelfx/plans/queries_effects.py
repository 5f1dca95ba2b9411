"""Effect-estimation queries on the order panel and the firm panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.effects import ESTIMATE_COLUMNS, cell_aipw, cell_aipw_rows
from . import sqlfrag as S
from .catalog import register, rounded
from .panel import order_panel

EFFECT_DIGITS = {"ate": 6, "se": 6, "ci_lower": 6, "ci_upper": 6, "z": 4, "p_value": 4,
                 "effect_pct": 4, "treated_pct": 4}

# SQL for the cell-mean nuisances on the order panel, per year.
_ORDER_CELL_CTES = """
cell as (select year, segment, region, avg(t) ps_raw, avg(case when t=1 then y end) m1,
                avg(case when t=0 then y end) m0, sum(t) n1, count(*) - sum(t) n0
         from base group by year, segment, region),
yr as (select year, avg(case when t=1 then y end) g1, avg(case when t=0 then y end) g0 from base group by year),
scored as (select b.*, least(greatest(ps_raw, 0.01), 0.99) ps,
                  case when n1 > 0 then m1 else coalesce(g1, 0) end mu1,
                  case when n0 > 0 then m0 else coalesce(g0, 0) end mu0
           from base b join cell using (year, segment, region) join yr using (year)),
psi as (select year, t, t*(y-mu1)/ps + mu1 - (1-t)*(y-mu0)/(1-ps) - mu0 as psi from scored),
est as (select year, count(*)::bigint n, sum(t)::bigint n_treated, 100.0 * sum(t) / count(*) treated_pct,
               avg(psi) ate, sqrt(var_pop(psi) / count(*)) se
        from psi group by year having count(*) >= {min_rows})"""


def _est_select(key: str) -> str:
    return (f"select {key}, n, n_treated, {S.r('treated_pct', 4)} treated_pct, {S.r('ate')} ate, {S.r('se')} se, "
            f"{S.r('ci_lower')} ci_lower, {S.r('ci_upper')} ci_upper, {S.r('z', 4)} z, "
            f"{S.r('p_value', 4)} p_value, {S.r('effect_pct', 4)} effect_pct "
            f"from (select *, {S.finish()} from est) e")


def effect_by_year(spark, sf_dir, min_rows: int = 500):
    """Flagship (#98 with the cell learner): AIPW per order year.  Treatment:
    priority URGENT/HIGH; outcome ln(total price); nuisances: cell means by
    (segment, region) within the year, year mean for an empty arm, ps clipped
    to [.01, .99]; years below ``min_rows`` rows are skipped (#20)."""
    res = cell_aipw(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"],
                    clip=(0.01, 0.99), min_rows=min_rows)
    return rounded(res.select("year", *ESTIMATE_COLUMNS), EFFECT_DIGITS)


register("effect_by_period", S.with_orders(_ORDER_CELL_CTES.format(min_rows=500), _est_select("year")))(
    effect_by_year)


@register("aipw_effect", S.with_orders(_ORDER_CELL_CTES.format(min_rows=0), _est_select("year")))
def q_aipw_effect(spark, sf_dir):
    """#88 row-level plan: nuisance table joined back, psi per row, grouped."""
    res = cell_aipw_rows(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"])
    return rounded(res.select("year", *ESTIMATE_COLUMNS), EFFECT_DIGITS)


@register("aipw_influence", S.with_orders(_ORDER_CELL_CTES.format(min_rows=0).replace(
    "psi as (select year, t,", "psi as (select year, id, t,"), """
select year, count(*)::bigint n, round(max(abs(psi - ate)), 6) max_abs_influence,
  round(avg((psi - ate) * (psi - ate)), 6) mean_sq_influence
from psi join (select year, avg(psi) ate from psi group by year) a using (year) group by year"""))
def q_aipw_influence(spark, sf_dir):
    """#88 influence column: psi - ate per row (group mean joined back)."""
    from ..operators.effects import aipw_influence
    from ..operators.learners import cell_nuisances
    scored = cell_nuisances(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"])
    inf = aipw_influence(scored, by=["year"])
    return inf.groupBy("year").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.max(F.abs("influence")), 6).alias("max_abs_influence"),
                                   F.round(F.avg(F.col("influence") * F.col("influence")), 6).alias("mean_sq_influence"))
