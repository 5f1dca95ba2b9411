"""Properties of the estimators and resampling operators."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from panelfx.operators import effects as E
from panelfx.operators import heterogeneity as HT
from panelfx.operators import impute as IM
from panelfx.operators import production as PD
from panelfx.operators import resample as RS
from panelfx.operators.gram import ols, predict
from panelfx.operators.learners import cell_nuisances
from panelfx.plans.firm import clean_firm_panel
from panelfx.plans.panel import order_panel
from panelfx.plans.queries_models import firm_analysis


def test_moment_plan_equals_row_plan(spark):
    d = order_panel(spark, MEDIUM)
    a = E.cell_aipw(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    b = E.cell_aipw_rows(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    for x, y in zip(a, b):
        assert x["n"] == y["n"]
        assert x["ate"] == pytest.approx(y["ate"], abs=1e-12)
        assert x["se"] == pytest.approx(y["se"], rel=1e-9)


def test_unclipped_cell_aipw_is_weighted_difference(spark):
    d = order_panel(spark, MEDIUM)
    est = E.cell_aipw(d, "t", "y", ["segment"], clip=None).first()
    cells = d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("m1"),
                                     F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("m0")).collect()
    n = sum(r["n"] for r in cells)
    expect = sum(r["n"] * (r["m1"] - r["m0"]) for r in cells) / n
    assert est["ate"] == pytest.approx(expect, abs=1e-12)


def test_planted_effect_shifts_estimate(spark):
    d = order_panel(spark, MEDIUM)
    base = E.cell_aipw(d, "t", "y", ["segment", "region"]).first()["ate"]
    shifted = d.withColumn("y", F.col("y") + 0.1 * F.col("t"))
    moved = E.cell_aipw(shifted, "t", "y", ["segment", "region"]).first()["ate"]
    assert moved - base == pytest.approx(0.1, abs=1e-9)


def test_tmle_moment_plan_equals_row_plan(spark):
    d = order_panel(spark, MEDIUM)
    a = HT.tmle_cell(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    b = HT.tmle_cell_rows(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    for x, y in zip(a, b):
        assert x["n"] == y["n"] and x["ate"] == pytest.approx(y["ate"], abs=1e-12)
        assert x["epsilon"] == pytest.approx(y["epsilon"], abs=1e-12)
        assert x["se"] == pytest.approx(y["se"], rel=1e-9)


def test_tmle_with_cell_nuisances_equals_aipw(spark):
    d = order_panel(spark, MEDIUM)
    t = HT.tmle_cell_rows(d, "t", "y", ["segment", "region"], clip=None).first()
    a = E.cell_aipw(d, "t", "y", ["segment", "region"], clip=None).first()
    assert abs(t["epsilon"]) < 1e-10
    assert abs(t["score_sum"]) < 1e-6
    assert t["ate"] == pytest.approx(a["ate"], abs=1e-9)


def test_ols_matches_numpy_and_residuals_orthogonal(spark):
    d = PD.log_inputs(clean_firm_panel(spark, MEDIUM)).select("y", "k", "l", "m").dropna()
    c = ols(d, "y", ["k", "l", "m"]).first()
    pdf = d.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.k, pdf.l, pdf.m])
    b = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    assert np.allclose(c["coef"], b, atol=1e-9)
    res = predict(d, spark.createDataFrame([(c["coef"],)], "coef array<double>"), ["k", "l", "m"], out="f")
    r = res.select(*(F.sum((F.col("y") - F.col("f")) * F.col(x)).alias(x) for x in ("k", "l", "m"))).first()
    assert all(abs(v) < 1e-6 for v in r)


def test_stage2_sits_at_lower_bound(spark):
    _, est = PD.add_outcomes(clean_firm_panel(spark, SMALL))
    e = est.first()
    assert e["at_bound"] and e["beta_k"] == pytest.approx(0.01)
    assert abs(e["beta_k_unbounded"]) < 1e-8


def test_permutation_keeps_treated_count(spark):
    d = firm_analysis(spark, SMALL).select("firm_id", "year", "t", "y", "hs")
    n1 = d.agg(F.sum("t")).first()[0]
    perm = RS.permute_within_replicates(d, ["t"], ["firm_id", "year"], R=5, seed=3)
    per = perm.groupBy("r").agg(F.sum("t").alias("n1"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 5
    assert all(r["n1"] == n1 and r["n"] == d.count() for r in per)


def test_bucket_rank_equals_window_rank(spark):
    df = spark.range(0, 3000).withColumn("p", (F.col("id") % 4).cast("int")).withColumn(
        "h", F.pmod(F.xxhash64("id"), F.lit(2 ** 32)))
    r = RS.hash_rank(df, ["p"], "h", ["id"], "rk", n_buckets=7)
    w = df.withColumn("rk2", F.row_number().over(Window.partitionBy("p").orderBy("h", "id")))
    assert r.join(w, "id").where("rk != rk2").count() == 0


def test_folds_disjoint_and_complete(spark):
    d = RS.fold_assign(order_panel(spark, SMALL), 5, 42, ["id"])
    rows = d.groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in rows) == d.count()


def test_imputation_keeps_observed_cells(spark):
    d = firm_analysis(spark, SMALL)
    cols = ["total_debt", "rd_employees_total"]
    imp = IM.impute_chained(d, cols, M=2, max_iter=2, extra_predictors=["y"], row_key=["firm_id", "year"])
    j = imp.join(d.select("firm_id", "year", *[F.col(c).alias(f"o_{c}") for c in cols]), ["firm_id", "year"])
    for c in cols:
        assert j.where(F.col(f"o_{c}").isNotNull() & (F.col(c) != F.col(f"o_{c}"))).count() == 0
        assert j.where(F.col(c).isNull()).count() == 0
    # The two chains differ where values were missing (posterior draws).
    a = imp.where("m = 1").select("firm_id", "year", F.col(cols[0]).alias("a"))
    b = imp.where("m = 2").select("firm_id", "year", F.col(cols[0]).alias("b"))
    assert a.join(b, ["firm_id", "year"]).where("a != b").count() > 0


def test_merge_keep_first_last(spark):
    from panelfx.operators.runs import merge_runs
    df = spark.createDataFrame([(1, "a", 0, 1, 1.0), (1, "a", 1, 0, 2.0), (2, "b", 0, 5, 3.0)],
                               "seed int, method string, file_no int, line_no int, v double")
    first = {r["seed"]: r["v"] for r in merge_runs(df, "keep_first", ["seed", "method"]).collect()}
    last = {r["seed"]: r["v"] for r in merge_runs(df, "keep_last", ["seed", "method"]).collect()}
    avg = {r["seed"]: r["v"] for r in merge_runs(df, "average", ["seed", "method"]).collect()}
    assert first == {1: 1.0, 2: 3.0} and last == {1: 2.0, 2: 3.0} and avg == {1: 1.5, 2: 3.0}


def test_quantile_bucket_label_mismatch_raises(spark):
    from panelfx.operators.bins import quantile_bucket
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 2, 3]], "x double")
    with pytest.raises(Exception):
        quantile_bucket(df, "x", 4, ["a", "b", "c", "d"]).collect()


def test_jacobi_schedule_keeps_observed_cells(spark):
    d = firm_analysis(spark, SMALL)
    cols = ["total_debt", "rd_employees_total", "direct_export_amount"]
    imp = IM.impute_chained(d, cols, M=2, max_iter=2, extra_predictors=["y"], row_key=["firm_id", "year"],
                            schedule="jacobi")
    j = imp.join(d.select("firm_id", "year", *[F.col(c).alias(f"o_{c}") for c in cols]), ["firm_id", "year"])
    for c in cols:
        assert j.where(F.col(f"o_{c}").isNotNull() & (F.col(c) != F.col(f"o_{c}"))).count() == 0
        assert j.where(F.col(c).isNull()).count() == 0
    assert imp.count() == 2 * d.count()


def test_hot_cell_third_of_rows(spark):
    """One cell holds a third of all rows: the one-scan moment plan (partial
    aggregation, no per-cell task) still equals the row-level plan."""
    d = order_panel(spark, MEDIUM)
    hot = F.col("id") % 3 == 0
    d = d.withColumn("segment", F.when(hot, F.lit("HOT")).otherwise(F.col("segment"))) \
         .withColumn("region", F.when(hot, F.lit(0)).otherwise(F.col("region")))
    a = E.cell_aipw(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    b = E.cell_aipw_rows(d, "t", "y", ["segment", "region"], by=["year"]).orderBy("year").collect()
    for x, y in zip(a, b):
        assert x["n"] == y["n"] and x["ate"] == pytest.approx(y["ate"], abs=1e-12)
        assert x["se"] == pytest.approx(y["se"], rel=1e-9)


def test_linear_learner_matches_numpy(spark):
    from panelfx.operators.learners import fit_predict
    d = order_panel(spark, SMALL).withColumn("x", F.col("region").cast("double"))
    p = fit_predict(d, "y", ["x"], "linear", train="t = 1", by=["year"], out="mu1").where("year = 1995")
    pdf = p.select("x", "y", "t", "mu1").toPandas()
    tr = pdf[pdf.t == 1]
    b = np.polyfit(tr.x, tr.y, 1)
    assert np.allclose(pdf.mu1, b[1] + b[0] * pdf.x, atol=1e-9)


def test_tree_learners_per_group(spark):
    """Forests and boosted trees return a probability in [0, 1] for every row, and outcomes per group."""
    from panelfx.operators.learners import fit_predict
    d = firm_analysis(spark, SMALL)
    feats = ["hs", "region", "industry_2digit"]
    n = d.count()
    for learner, params in (("forest", dict(trees=5, depth=3)), ("gbt", dict(trees=5, depth=2))):
        p = fit_predict(d, "t", feats, learner, out="ps", classify=True, **params)
        r = p.agg(F.count("ps").alias("n"), F.min("ps").alias("lo"), F.max("ps").alias("hi")).first()
        assert r["n"] == n and 0.0 <= r["lo"] <= r["hi"] <= 1.0, learner
    mu = fit_predict(d, "y", feats, "forest", train="t = 1", by=["region"], out="mu1", trees=5, depth=3)
    assert mu.where(F.col("mu1").isNull()).count() == 0 and mu.count() == n


def test_xxhash_permutation_keeps_counts(spark):
    d = firm_analysis(spark, SMALL).select("firm_id", "year", "t", "y", "hs")
    n1 = d.agg(F.sum("t")).first()[0]
    perm = RS.permute_within_replicates(d, ["t"], ["firm_id", "year"], R=3, seed=5, hash_method="xxhash")
    per = perm.groupBy("r").agg(F.sum("t").alias("n1"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 3 and all(r["n1"] == n1 and r["n"] == d.count() for r in per)
