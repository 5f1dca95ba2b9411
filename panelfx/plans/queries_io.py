"""Source/sink round trips (#1, #3-#11).  Each query writes derived data
under a fresh folder inside the session's shared checkpoint folder, reads
it back with the library readers and reports counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import effects as E
from ..operators import impute as IM
from ..operators import production as PD
from ..operators import runs as R
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from . import sqlfrag as S
from .catalog import register
from .firm import CLEAN_SQL, clean_firm_panel
from .panel import firm_panel, order_panel
from .queries_models import FA, O, _aipw_sql, _cell_sql, firm_analysis
from .runs_fixture import run_table, with_runs


def scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/panelfx-scratch/{name}-{uuid.uuid4().hex}"


@register("read_yearly", S.with_panel("", """
select year, count(*)::bigint n, count(energy)::bigint n_energy, round(sum(revenue), 2) revenue
from (select year, revenue, null::double energy from panel where year <= 1997
      union all select year, revenue, energy from panel where year > 1997) u
group by year"""))
def q_read_yearly(spark, sf_dir):
    """#1 + #2: one CSV per year (early years without the ``energy``
    column), read back as strings by header name, absent years skipped,
    stacked by name."""
    root = scratch(spark, "yearly")
    p = firm_panel(spark, sf_dir).select("year", "firm_id", "revenue", "energy")
    span = p.agg(F.min("year").alias("first"), F.max("year").alias("last")).first()
    # One pass per header: the writer deals the rows into one folder per year.
    for part in (p.where("year <= 1997").drop("energy"), p.where("year > 1997")):
        part.write.mode("append").partitionBy("year").option("header", True).csv(root)
    df = IO.read_yearly(spark, root + "/year={year}", range(span["first"] - 1, span["last"] + 2))
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("energy").alias("n_energy"),
                                  F.round(F.sum(F.col("revenue").cast("double")), 2).alias("revenue"))


@register("imputation_roundtrip", FA("""select 3::bigint n_imputations, count(*)::bigint rows_min,
  count(*)::bigint rows_max, 11 n_variables, (select count(*) from fa)::bigint rows_m2 from fa"""))
def q_imputation_roundtrip(spark, sf_dir):
    """#4, #5, #6, #8: M = 3 completed copies written as one table partitioned
    by m, metadata from the stored table, one imputation read back by
    partition pruning."""
    root = scratch(spark, "imputations")
    d = IM.stack_imputations(IM.impute_mean(firm_analysis(spark, sf_dir), ["total_debt", "rd_employees_total"]), 3)
    IO.write_imputations(d, root)
    back = spark.read.parquet(root)
    meta = IO.imputation_metadata(back).drop("variables")
    m2 = IO.read_imputations(spark, root, m=2).agg(F.count(F.lit(1)).alias("rows_m2"))
    return meta.withColumn("n_variables", F.col("n_variables").cast("int")).crossJoin(F.broadcast(m2))


_STARS = "case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else '' end"


@register("result_report", O(f"""select printf('AIPW (cell means): ATE=%.6f SE=%.6f 95%% CI=[%.6f, %.6f] z=%.4f p=%.6f %s; effect %+.2f%%',
    ate, se, ci_lower, ci_upper, z, p_value,
    case when p_value < 0.05 then 'significant ' || {_STARS} else 'not significant (p >= 0.05)' end, effect_pct) as value,
  (select count(*) from est)::bigint n_csv_rows, (select count(distinct year) from est)::bigint n_csv_years
from (select *, {S.finish()} from est) e""", _cell_sql("base", ["year"], ["segment", "region"]).lstrip() + "," + _aipw_sql("sc", ["year"])))
def q_result_report(spark, sf_dir):
    """#9 + #10: estimate rows to one CSV and readable report lines to text;
    both read back."""
    root = scratch(spark, "results")
    est = E.cell_aipw(order_panel(spark, sf_dir), "t", "y", ["segment", "region"], by=["year"])
    IO.write_results(est, f"{root}/csv")
    rep = IO.result_report(est, "AIPW (cell means)")
    IO.write_report(rep, f"{root}/report")
    csv = spark.read.option("header", True).csv(f"{root}/csv").agg(F.count(F.lit(1)).alias("n_csv_rows"), F.count_distinct("year").alias("n_csv_years"))
    return spark.read.text(f"{root}/report").crossJoin(F.broadcast(csv))


@register("read_result_files", with_runs("""
select file_no, count(*)::bigint n, count(distinct seed)::bigint n_seeds,
  count(case when file_no <> 2 then ci_upper end)::bigint n_ci, count(distinct method)::bigint n_methods,
  round(avg(ate_est), 6) ate_mean from runs group by file_no"""))
def q_read_result_files(spark, sf_dir):
    """#11: run tables written as one CSV folder per file with columns in
    another order (file 1) and an absent column (file 2), read back by name;
    the file number is the order of the patterns, which is not that of the paths."""
    root = scratch(spark, "runs")
    rt = run_table(spark, sf_dir)
    for i in range(4):
        part = rt.where(F.col("file_no") == i).drop("file_no")
        part = part.select(*reversed(part.columns)) if i == 1 else part.drop("ci_upper") if i == 2 else part
        part.coalesce(1).write.option("header", True).csv(f"{root}/{'dbca'[i]}_results")
    df = IO.read_result_files(spark, [f"{root}/{c}_res*" for c in "dbca"])
    return df.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("n_seeds"),
                                     F.count("ci_upper").alias("n_ci"), F.count_distinct("method").alias("n_methods"),
                                     F.round(F.avg("ate_est"), 6).alias("ate_mean"))


@register("merge_result_files", with_runs("""
select method, count(*)::bigint n, round(sum(ate_est), 6) ate_sum from (
  select *, row_number() over (partition by n, p, imbalance_ratio, missing_rate, scenario, seed, method
                               order by case file_no when 3 then 0 when 2 then 1 when 1 then 2 else 3 end) k from runs) x
where k = 1 group by method"""))
def q_merge_result_files(spark, sf_dir):
    """#11 + #63: result files read in a given order and merged by it (the
    file named first wins), lines of a file by their own order."""
    root = scratch(spark, "merge")
    rt = run_table(spark, sf_dir)
    for i in range(4):
        part = rt.where(F.col("file_no") == i).drop("file_no", "line_no")
        part.coalesce(1).write.option("header", True).csv(f"{root}/results_{i}")
    df = IO.read_result_files(spark, [f"{root}/results_{i}" for i in (3, 2, 1, 0)])
    kept = R.merge_runs(df, "keep_first")
    return kept.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ate_est"), 6).alias("ate_sum"))


@register("read_selected_variables", FA("""select count(hs)::bigint hs, count(region)::bigint region,
  count(total_debt)::bigint total_debt from fa"""))
def q_selected_variables(spark, sf_dir):
    """#7: a stored covariate list restricts the covariates; an
    absent list means all."""
    root = scratch(spark, "selected")
    fa = firm_analysis(spark, sf_dir)
    spark.createDataFrame([(c,) for c in ("hs", "region", "total_debt")], "variable string") \
        .coalesce(1).write.option("header", True).csv(root)
    assert IO.read_selected_variables(spark, root + "-absent") is None
    listed = IO.read_selected_variables(spark, root) or fa.columns
    cols = [c for c in fa.columns if c in set(listed)]
    return fa.agg(*[F.count(c).alias(c) for c in cols])


@register("outcome_tables_roundtrip", S.with_panel(CLEAN_SQL.strip() + """,
li2 as (select ln(greatest(revenue, 1)) y, ln(greatest(capital, 1)) k, ln(greatest(employees, 1)) l from clean)""", """
select imp, count(*)::bigint rows, count(y - k - l)::bigint n_lp, round(avg(y - 0.3 * k - 0.7 * l), 4) tfp_simple_mean, 0.01::double beta_k, 1 at_bound,
  (select count(*) from clean)::bigint first_csv_rows, 11::bigint n_csv_columns from li2, range(1, 3) mm(imp) group by imp"""))
def q_outcome_tables(spark, sf_dir):
    """#8: production outcomes estimated per imputation m (stage 1 and 2
    grouped by m), written partitioned by m with a CSV of the first
    imputation, read back."""
    root = scratch(spark, "outcomes")
    stacked = IM.stack_imputations(IM.impute_mean(clean_firm_panel(spark, sf_dir), ["total_debt"]), 2, m_col="imp")
    rows, est = PD.add_outcomes(stacked, by=["imp"])
    IO.write_outcome_tables(rows.select("firm_id", "year", "imp", "y", "k", "l", "m_total", "phi_hat", "beta_l",
                                        "tfp_lp", "tfp_simple"), f"{root}/parquet", m_col="imp",
                            first_csv=f"{root}/first_csv")
    back = spark.read.parquet(f"{root}/parquet")
    csv = spark.read.option("header", True).csv(f"{root}/first_csv")
    per_m = back.groupBy("imp").agg(F.count(F.lit(1)).alias("rows"), F.count("tfp_lp").alias("n_lp"), F.round(F.avg("tfp_simple"), 4).alias("tfp_simple_mean"))
    bound = est.select(F.col("imp").cast("int").alias("imp"), F.round("beta_k", 6).alias("beta_k"), F.col("at_bound").cast("int").alias("at_bound"))
    return per_m.join(bound, "imp").select(F.col("imp").cast("long").alias("imp"), "rows", "n_lp", "tfp_simple_mean", "beta_k", "at_bound",
                                           F.lit(csv.count()).cast("long").alias("first_csv_rows"), F.lit(len(csv.columns)).cast("long").alias("n_csv_columns"))
