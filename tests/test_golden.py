"""Formula checks against published numbers (fixed values copied as text)."""

import math

import pytest
from pyspark.sql import functions as F

from panelfx.functions import expr as X
from panelfx.functions import stats as ST
from panelfx.operators import effects as E

# The ten per-imputation TMLE rows (ate, se) and the pooled row
# (ate, se, W, B, df) published with the reference analysis.
TMLE_ROWS = [
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656257478846796, 0.006233288204446598),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656951129651525, 0.006233304400314913),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656656863324398, 0.006233297058242988),
    (-0.06656656863324398, 0.006233297058242988),
]
TMLE_POOLED = dict(ate=-0.0665664635150935, se=0.006233297147264814, W=3.8853990331708385e-05,
                   B=2.722173885275464e-12, df=1515293411530006.8, ci_lower=-0.0787835014286688,
                   ci_upper=-0.054349425601518196, t_stat=-10.679173789156359, effect_pct=-6.439926952344733)

# Published period rows (ate, se, p printed by the reference formula).
PERIOD_ROWS = [
    (0.013760253152058801, 0.0031379653175066503, 6.675394791866296e-05),
    (-0.006782915789843092, 0.002513098352966419, 1.9738097616736126),
    (0.002257300883176997, 0.0023522065523801064, 0.6309892493139364),
]


def test_rubin_pooling_matches_published(spark):
    rows = spark.createDataFrame([(i + 1, a, s) for i, (a, s) in enumerate(TMLE_ROWS)], "m int, ate double, se double")
    got = E.pool_rubin(rows, [], reference="t").first().asDict()
    for k, v in TMLE_POOLED.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k
    assert got["M"] == 10


def test_reference_p_form_reproduces_published(spark):
    df = spark.createDataFrame(PERIOD_ROWS, "ate double, se double, p double")
    out = df.select("p", X.p_value_reference_form(F.col("ate") / F.col("se")).alias("q")).collect()
    for r in out:
        assert r["q"] == pytest.approx(r["p"], rel=1e-9)


def test_percent_effect_and_ci(spark):
    df = spark.createDataFrame([TMLE_POOLED["ate"]], "double").toDF("ate")
    pct = df.select(X.percent_effect("ate")).first()[0]
    assert pct == pytest.approx(TMLE_POOLED["effect_pct"], rel=1e-12)


def test_normal_p_polynomial(spark):
    df = spark.createDataFrame([(z,) for z in (-3.0, -1.96, -0.5, 0.0, 0.7, 1.96, 4.0)], "z double")
    for r in df.select("z", X.normal_two_sided_p("z").alias("p")).collect():
        exact = math.erfc(abs(r["z"]) / math.sqrt(2.0))
        assert abs(r["p"] - exact) < 3e-7


def test_t_distribution():
    assert ST.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-8)
    assert ST.t_ppf(0.975, 1) == pytest.approx(12.706204736174698, rel=1e-7)
    assert ST.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, rel=1e-9)
    assert ST.t_ppf(0.975, 2e15) == pytest.approx(1.959963984540054, rel=1e-9)
