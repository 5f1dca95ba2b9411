"""Run-table queries (#12, #19, #56-68) on the derived run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.frame import union_by_name
from ..sources import io as IO
from .catalog import register, rounded
from .runs_fixture import run_table, with_runs

_KEY_SQL = "n, p, imbalance_ratio, missing_rate, scenario, seed, method"


@register("run_metrics", with_runs("""
select method, count(*)::bigint n, sum(coverage)::bigint covered, round(avg(bias), 6) bias_mean,
  round(avg(squared_error), 6) mse, round(avg(ci_width), 6) ci_width from runs group by method"""))
def q_run_metrics(spark, sf_dir):
    rt = run_table(spark, sf_dir)
    return rounded(rt.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("coverage").cast("long").alias("covered"),
        F.avg("bias").alias("bias_mean"), F.avg("squared_error").alias("mse"), F.avg("ci_width").alias("ci_width")),
        {}, default=6)


@register("clean_runs", with_runs("""
select count(*)::bigint total, count(case when error is null then 1 end)::bigint clean,
  round(100.0 * count(case when error is null then 1 end) / count(*), 4) clean_pct,
  (count(*) - count(case when error is null then 1 end))::bigint errors from runs"""))
def q_clean_runs(spark, sf_dir):
    return rounded(R.clean_run_counts(run_table(spark, sf_dir)), {"clean_pct": 4})


@register("run_summary", with_runs("""
select imbalance_ratio, missing_rate, method, round(avg(bias), 3) bias_mean, round(stddev_samp(bias), 3) bias_std,
  round(avg(coverage), 3) coverage, round(avg(runtime), 3) runtime, count(*)::bigint n_runs,
  round(avg(squared_error), 3) mse, round(sqrt(avg(squared_error)), 6) rmse
from runs where error is null group by imbalance_ratio, missing_rate, method"""))
def q_run_summary(spark, sf_dir):
    s = R.run_summary(R.clean_runs(run_table(spark, sf_dir)))
    return rounded(s, {"rmse": 6})


@register("rmse_approx", with_runs("""
select imbalance_ratio, missing_rate, method, round(avg(bias), 6) bias_mean, round(stddev_samp(ate_est), 6) ate_std,
  round(sqrt(avg(bias) * avg(bias) + stddev_samp(ate_est) * stddev_samp(ate_est)), 6) rmse_approx
from runs where error is null group by imbalance_ratio, missing_rate, method"""))
def q_rmse_approx(spark, sf_dir):
    return rounded(R.rmse_approx(R.clean_runs(run_table(spark, sf_dir))), {}, default=6)


@register("pivot_by_method", with_runs("""
select imbalance_ratio, missing_rate,
  max(case when method = 'diff' then b end) diff, max(case when method = 'cell_aipw' then b end) cell_aipw
from (select imbalance_ratio, missing_rate, method, round(avg(bias), 3) b from runs where error is null
      group by imbalance_ratio, missing_rate, method) s group by imbalance_ratio, missing_rate"""))
def q_pivot(spark, sf_dir):
    s = R.run_summary(R.clean_runs(run_table(spark, sf_dir)))
    return R.pivot_by_method(s, "bias_mean", ["diff", "cell_aipw"])


@register("compare_to_baseline", with_runs("""
select round(avg(bias), 6) bias_mean, round(avg(coverage), 6) coverage_mean,
  round(abs(avg(bias)) / 0.002, 6) bias_multiple, round(0.94 - avg(coverage), 6) coverage_drop
from runs where error is null and method = 'cell_aipw'"""))
def q_compare(spark, sf_dir):
    # The reference bias (~0.002) and coverage (~94 %) quoted
    # for the MAR setting.
    res = R.compare_to_baseline(R.clean_runs(run_table(spark, sf_dir)), "cell_aipw", 0.002, 0.94)
    return rounded(res, {}, default=6)


@register("union_runs", with_runs("""
select file_no, count(*)::bigint n, count(distinct seed)::bigint n_seeds from runs group by file_no"""))
def q_union_runs(spark, sf_dir):
    rt = run_table(spark, sf_dir)
    files = [rt.where(F.col("file_no") == i) for i in range(4)]
    u = union_by_name(files)
    return u.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("n_seeds"))


@register("count_duplicates", with_runs(f"""
select coalesce(sum(case when c > 1 then c end), 0)::bigint n_duplicate_rows
from (select {_KEY_SQL}, count(*) c from runs group by {_KEY_SQL}) g"""))
def q_count_duplicates(spark, sf_dir):
    return R.count_duplicates(run_table(spark, sf_dir))


def _merged_sql(order: str) -> str:
    return with_runs(f"""
select {_KEY_SQL}, file_no, round(runtime, 4) runtime, round(ate_est, 6) ate_est from (
  select *, row_number() over (partition by {_KEY_SQL} order by file_no {order}, line_no {order}) rn from runs) s
where rn = 1""")


def _merged(spark, sf_dir, strategy):
    m = R.merge_runs(run_table(spark, sf_dir), strategy)
    return rounded(m.select(*R.RUN_KEYS, "file_no", "runtime", "ate_est"), {"runtime": 4, "ate_est": 6})


@register("merge_runs_keep_first", _merged_sql("asc"))
def q_merge_first(spark, sf_dir):
    return _merged(spark, sf_dir, "keep_first")


@register("merge_runs_keep_last", _merged_sql("desc"))
def q_merge_last(spark, sf_dir):
    return _merged(spark, sf_dir, "keep_last")


@register("merge_runs_average", with_runs(f"""
select {_KEY_SQL}, round(avg(runtime), 4) runtime, round(avg(ate_est), 6) ate_est, round(avg(coverage), 4) coverage
from runs group by {_KEY_SQL}"""))
def q_merge_average(spark, sf_dir):
    m = R.merge_runs(run_table(spark, sf_dir), "average")
    return rounded(m.select(*R.RUN_KEYS, "runtime", "ate_est", "coverage"),
                   {"runtime": 4, "ate_est": 6, "coverage": 4})


@register("check_grid_consistency", with_runs("""
select g.file_no, count(*)::bigint n_conditions,
  ((select count(*) from ref) - count(r.n))::bigint n_missing, (count(*) - count(r.n))::bigint n_extra,
  cast((select count(*) from ref) - count(r.n) = 0 and count(*) - count(r.n) = 0 as integer) consistent
from grid g left join ref r using (n, p, imbalance_ratio, missing_rate, scenario)
group by g.file_no""", """
grid as (select distinct file_no, n, p, imbalance_ratio, missing_rate, scenario from runs),
ref as (select distinct n, p, imbalance_ratio, missing_rate, scenario from grid where file_no = (select min(file_no) from runs))"""))
def q_grid(spark, sf_dir):
    return R.check_grid_consistency(run_table(spark, sf_dir))


@register("merged_statistics", with_runs("""
select count(*)::bigint total_rows, count(distinct method)::bigint n_methods, count(error)::bigint n_errors,
  round(count(error) / count(*), 6) error_rate, round(avg(ate_est), 6) ate_mean, round(stddev_samp(ate_est), 6) ate_std,
  round(min(ate_est), 6) ate_min, round(max(ate_est), 6) ate_max,
  (select count(*) from rep)::bigint n_conditions, (select min(r) from rep)::bigint min_replications,
  (select max(r) from rep)::bigint max_replications, (select round(avg(r), 6) from rep) mean_replications
from merged""", f"""
merged as (select * from (select *, row_number() over (partition by {_KEY_SQL} order by file_no, line_no) rn
                          from runs) s where rn = 1),
rep as (select n, p, imbalance_ratio, missing_rate, scenario, count(distinct seed) r from merged
        group by n, p, imbalance_ratio, missing_rate, scenario)"""))
def q_merged_statistics(spark, sf_dir):
    m = R.merge_runs(run_table(spark, sf_dir), "keep_first")
    return rounded(R.merged_statistics(m), {}, default=6)


def _grid(rt):
    return R.parameter_grid(rt.select("imbalance_ratio").distinct(), rt.select("missing_rate").distinct(),
                            rt.select("scenario").distinct())


_GRID_SQL = """
grid as (select * from (select distinct imbalance_ratio from runs) a, (select distinct missing_rate from runs) b,
                       (select distinct scenario from runs) c),
done as (select imbalance_ratio, missing_rate, scenario, count(distinct seed) n_seeds from runs where error is null
         group by imbalance_ratio, missing_rate, scenario having count(distinct seed) >= 12)"""


@register("parameter_grid", with_runs("select imbalance_ratio, missing_rate, scenario from grid", _GRID_SQL))
def q_parameter_grid(spark, sf_dir):
    return _grid(run_table(spark, sf_dir))


@register("completed_conditions", with_runs(
    "select g.imbalance_ratio, g.missing_rate, g.scenario, n_seeds::bigint n_seeds from grid g "
    "join done using (imbalance_ratio, missing_rate, scenario)", _GRID_SQL))
def q_completed(spark, sf_dir):
    rt = run_table(spark, sf_dir)
    return R.completed_conditions(R.clean_runs(rt), _grid(rt), 12)


@register("pending_conditions", with_runs(
    "select imbalance_ratio, missing_rate, scenario from grid g where not exists (select 1 from done d where "
    "d.imbalance_ratio = g.imbalance_ratio and d.missing_rate = g.missing_rate and d.scenario = g.scenario)",
    _GRID_SQL))
def q_pending(spark, sf_dir):
    rt = run_table(spark, sf_dir)
    return R.pending_conditions(R.clean_runs(rt), _grid(rt), 12)


@register("latest_checkpoint", with_runs("""
select file_no, max(i)::bigint latest, arg_max(name, i) name from (
  select file_no, name, cast(regexp_extract(name, '_([0-9]+)of([0-9]+)\\.csv$', 1) as bigint) i,
         regexp_extract(name, '_([0-9]+)of([0-9]+)\\.csv$', 2) tot from names) s
where tot = '7' group by file_no""", """
names as (select distinct file_no, 'runs_' || cast(seed % 10000 - 1994 as varchar) || 'of7.csv' name from runs
          union all select distinct file_no, 'runs_final.csv' from runs
          union all select distinct file_no, 'runs_9of12.csv' from runs)"""))
def q_latest_checkpoint(spark, sf_dir):
    """#12 on checkpoint names derived from the run table (one per seed
    year, plus names that do not match or belong to another total)."""
    rt = run_table(spark, sf_dir)
    names = (rt.select("file_no", F.concat(F.lit("runs_"), (F.col("seed") % 10000 - 1994).cast("string"),
                                           F.lit("of7.csv")).alias("name"))
             .unionByName(rt.select("file_no", F.lit("runs_final.csv").alias("name")))
             .unionByName(rt.select("file_no", F.lit("runs_9of12.csv").alias("name"))).distinct())
    return IO.latest_checkpoint(names, "name", total=7, by=["file_no"])
