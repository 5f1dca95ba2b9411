"""Grouped models: cross products, logistic regression, trees, cross-fitting and targeting against plain refits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.operators import effects, learners, logistic, resample, trees
from panelfx.operators.gram import gram_sums


def rows(n=900, groups=("a", None, "b"), seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])
        t = int(rng.random() < 1 / (1 + math.exp(-(0.8 * x - 0.5 * z))))
        out.append((i, groups[i % len(groups)], x, z, t, 1.0 + 2 * x - z + 0.7 * t + rng.gauss(0, 0.5)))
    return out


SCHEMA = "id long, g string, x double, z double, t int, y double"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def test_sums_keep_null_groups_and_types(spark, data):
    got = {r.g: r for r in gram_sums(data, "y", ["x"], by=["g"]).collect()}
    assert set(got) == {"a", "b", None} and all(r.n == 300 for r in got.values())
    typed = data.withColumn("d", F.expr("date'2020-01-01'")).withColumn("b", F.col("t") == 1)
    assert {(r.d.year, r.b) for r in gram_sums(typed, "y", [], by=["d", "b"]).collect()} == {(2020, True), (2020, False)}
    weighted = gram_sums(data.withColumn("w", F.lit(2.0)), "y", ["x"], weight="w").first()
    assert weighted.n == 1800 and weighted.xtx[0] == 1800


def test_logistic_equals_spark_ml(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    one = data.where("g = 'a'")
    got = logistic.logistic_fit(one, "t", ["x", "z"], penalty=3.0).first()
    v = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(one).withColumn("label", F.col("t").cast("double"))
    model = LogisticRegression(featuresCol="f", regParam=3.0 / one.count(), elasticNetParam=0.0, standardization=False, tol=1e-14, maxIter=500).fit(v)
    assert got.converged and got.coef == pytest.approx([model.intercept, *model.coefficients], abs=1e-6)
    p = logistic.logistic_predict(one, logistic.logistic_fit(one, "t", ["x", "z"], penalty=3.0), ["x", "z"])
    s = p.agg(*[F.sum((F.col("t") - F.col("ps")) * c).alias(n) for n, c in (("one", F.lit(1.0)), ("x", F.col("x")), ("z", F.col("z")))]).first()
    assert [s.one, s.x - 3 * got.coef[1], s.z - 3 * got.coef[2]] == pytest.approx([0, 0, 0], abs=1e-6)


def test_logistic_separable_and_one_class(spark):
    df = spark.createDataFrame([("s", float(i), int(i > 9)) for i in range(20)] + [("one", float(i), 1) for i in range(5)] + [("none", None, 1)], "g string, x double, t int")
    got = {r.g: r for r in logistic.logistic_fit(df, "t", ["x"], ["g"], penalty=1e-4).collect()}
    assert set(got) == {"s", "one"} and got["s"].converged and got["s"].coef[1] > 3 and got["one"].coef[0] > 5
    assert logistic.logistic_fit(df.where("false"), "t", ["x"], ["g"]).collect() == []


def jobs_of(spark, action):
    """Jobs that an action starts."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = action()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


def test_a_thousand_groups_take_as_many_steps_as_a_few(spark):
    rng = random.Random(2)
    many = spark.createDataFrame([(g, rng.gauss(0, 1), int(rng.random() < 0.4)) for g in range(1000) for _ in range(20)], "g int, x double, t int").repartition(4)
    few = many.where("g < 3")
    a, n_many = jobs_of(spark, lambda: logistic.logistic_fit(many, "t", ["x"], ["g"]).collect())
    _, n_few = jobs_of(spark, lambda: logistic.logistic_fit(few, "t", ["x"], ["g"]).collect())
    assert len(a) == 1000 and all(r.converged for r in a) and n_many <= n_few + 6  # a few more steps at most


def test_cross_validated_penalty(spark, data):
    d = resample.fold_assign(data, 5, 42, ["id"], "fold")
    for score in ("accuracy", "log_loss"):
        got = {r.g: r for r in logistic.logistic_cv(d, "t", ["x", "z"], ["g"], score=score).collect()}
        for g in ("a", None):
            local = d.where(F.col("g").eqNullSafe(g)).toPandas()
            best = []
            for lam in sorted(logistic.PENALTIES, reverse=True):
                value = []
                for f in range(5):
                    tr, te = local[local.fold != f], local[local.fold == f]
                    b = newton(tr[["x", "z"]].to_numpy(), tr.t.to_numpy(), lam)
                    eta = b[0] + te[["x", "z"]].to_numpy() @ b[1:]
                    value.append(((eta > 0) == (te.t == 1)).mean() if score == "accuracy" else -np.mean(np.logaddexp(0, eta) - eta * te.t))
                best.append(round(np.mean(value), 12))
            lam = sorted(logistic.PENALTIES, reverse=True)[int(np.argmax(best))]
            assert got[g].penalty == pytest.approx(lam)
            assert got[g].coef == pytest.approx(newton(local[["x", "z"]].to_numpy(), local.t.to_numpy(), lam), abs=1e-7)


def newton(X, t, lam):
    Z = np.column_stack([np.ones(len(X)), X])
    b = np.zeros(Z.shape[1])
    pen = np.diag([0.0] + [lam] * X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-Z @ b))
        b = b + np.linalg.solve((Z * (p * (1 - p))[:, None]).T @ Z + pen, Z.T @ (t - p) - pen @ b)
    return b


def least_squares(X, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(X)), X]), y, rcond=None)[0]


@pytest.mark.parametrize("other_arm", ["folds", "full"])
@pytest.mark.parametrize("learner", ["linear", "logistic"])
def test_crossfit_equals_refits(spark, data, learner, other_arm):
    d = resample.fold_assign(data, 5, 42, ["id"], "fold")
    got = learners.crossfit_nuisances(d, "t", "y", ["x", "z"], learner, "fold", 5, ["g"], None, 10, other_arm).toPandas().sort_values("id")
    assert len(got) == 900
    for g in ("a", "b"):
        local = got[got.g == g]
        for f in range(5):
            train, test = local[local.fold != f], local[local.fold == f]
            X, Z = train[["x", "z"]].to_numpy(), test[["x", "z"]].to_numpy()
            b = newton(X, train.t.to_numpy(), 1.0) if learner == "logistic" else least_squares(X, train.t)
            eta = b[0] + Z @ b[1:]
            assert np.allclose(test.ps, 1 / (1 + np.exp(-eta)) if learner == "logistic" else eta, atol=1e-8)
            for a in (1, 0):
                out = least_squares(X[train.t == a], train.y[train.t == a])
                whole = least_squares(local[local.t == a][["x", "z"]].to_numpy(), local.y[local.t == a])
                want = np.where((test.t != a) & (other_arm == "full"), whole[0] + Z @ whole[1:], out[0] + Z @ out[1:])
                assert np.allclose(test[f"mu{a}"], want, atol=1e-8)


def test_small_arms_fall_back_to_the_training_mean(spark):
    rng = random.Random(4)
    made = [(i, "s", rng.gauss(0, 1), 0.0, int(i < 9), rng.gauss(0, 1)) for i in range(60)] + [(100 + i, "only", rng.gauss(0, 1), 0.0, 0, 1.0 + i) for i in range(20)]
    d = resample.fold_assign(spark.createDataFrame(made, SCHEMA), 5, 42, ["id"], "fold")
    got = learners.crossfit_nuisances(d, "t", "y", ["x"], "linear", "fold", 5, ["g"]).toPandas()
    for _, r in got.iterrows():
        arm = got[(got.g == r.g) & (got.fold != r.fold) & (got.t == 1)]
        assert r.mu1 == pytest.approx(arm.y.mean() if len(arm) else 0.0)
    assert got[got.g == "s"].mu0.nunique() > 5


def test_crossfit_estimate(spark, data):
    got = resample.crossfit_aipw(data, "t", "y", ["x", "z"], ["id"], ["g"], learner="linear")
    d = resample.fold_assign(data, 5, 42, ["id"], "fold")
    p = learners.crossfit_nuisances(d, "t", "y", ["x", "z"], "linear", "fold", 5, ["g"]).toPandas()
    psi = p.mu1 - p.mu0 + p.t / p.ps * (p.y - p.mu1) - (1 - p.t) / (1 - p.ps) * (p.y - p.mu0)
    for r in got.collect():
        mine = psi[p.g == r.g] if r.g else psi[p.g.isna()]
        assert r.ate == pytest.approx(mine.mean()) and r.se == pytest.approx(mine.std(ddof=1) / math.sqrt(len(mine))) and abs(r.ate - 0.7) < 0.3
    cell = resample.crossfit_aipw(data, "t", "y", ["z"], ["id"], ["g"]).collect()
    assert {r.g: r.ate for r in cell} == pytest.approx({r.g: r.ate for r in resample.crossfit_cell_aipw(data, "t", "y", ["z"], ["id"], ["g"]).collect()})
    with pytest.raises(ValueError):
        resample.crossfit_aipw(data, "t", "y", ["x"], ["id"], learner="oracle")


@pytest.mark.parametrize("learner", ["linear", "logistic"])
def test_targeting(spark, data, learner):
    params = {"penalty": 1.0} if learner == "logistic" else {}
    got = {r.g: r for r in effects.tmle(data, "t", "y", ["x", "z"], learner, ["g"], **params).collect()}
    p = learners.nuisances(data, "t", "y", ["x", "z"], learner, ["g"], None, **params).toPandas()
    for g in ("a", "b"):
        d = p[p.g == g]
        e = d.ps.clip(0.01, 0.99)
        H = d.t / e - (1 - d.t) / (1 - e)
        eps = (H * (d.y - (d.t * d.mu1 + (1 - d.t) * d.mu0))).sum() / (H * H).sum()
        m1, m0 = d.mu1 + eps / e, d.mu0 - eps / (1 - e)
        ic = d.t / e * (d.y - m1) - (1 - d.t) / (1 - e) * (d.y - m0) + m1 - m0
        r = got[g]
        assert r.epsilon == pytest.approx(eps, abs=1e-10) and r.ate == pytest.approx((m1 - m0).mean()) and abs(r.score_sum) < 1e-6
        assert r.se == pytest.approx(ic.std(ddof=0) / math.sqrt(len(d)), rel=1e-9) and abs(r.ate - 0.7) < 0.3


def best_stump(x, r, w, least):
    """The cut with the largest decrease of the squared error, by trying all."""
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            if w[left].sum() >= least and w[~left].sum() >= least:
                gain = (r * w)[left].sum() ** 2 / w[left].sum() + (r * w)[~left].sum() ** 2 / w[~left].sum() - (r * w).sum() ** 2 / w.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, (f, v))
    return best[1]


def boosted(x, t, shape, score_x):
    """Plain boosting of depth-first trees on rows."""
    w = np.ones(len(x))
    mean = t.mean()
    start = math.log(mean / (1 - mean)) if shape.loss == "logistic" else mean
    score, out = np.full(len(x), start), np.full(len(score_x), start)

    def node(on, on_x, depth):
        p = 1 / (1 + np.exp(-score[on])) if shape.loss == "logistic" else score[on]
        h = p * (1 - p) if shape.loss == "logistic" else np.ones(on.sum())
        value = (t[on] - p).sum() / h.sum()
        cut = best_stump(x[on], t[on] - p, w[on], shape.min_leaf) if depth else None
        if cut is None:
            new[on], new_x[on_x] = value, value
            return
        f, v = cut
        node(on & (x[:, f] <= v), on_x & (score_x[:, f] <= v), depth - 1)
        node(on & (x[:, f] > v), on_x & (score_x[:, f] > v), depth - 1)

    for _ in range(shape.trees):
        new, new_x = np.zeros(len(x)), np.zeros(len(score_x))
        node(np.ones(len(x), bool), np.ones(len(score_x), bool), shape.depth)
        score, out = score + shape.rate * new, out + shape.rate * new_x
    return 1 / (1 + np.exp(-out)) if shape.loss == "logistic" else out


@pytest.mark.parametrize("task_cells", [10**9, 0])
@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_trees_are_plain_boosting(spark, loss, task_cells):
    rng = random.Random(6)
    made = [(g, float(rng.randint(0, 5)), None if rng.random() < 0.1 else float(rng.randint(0, 9)), rng.random()) for g in ("a", "b", None) for _ in range(150)]
    made = [(g, x, z, int(u < 0.2 + 0.1 * x), 2 * x + (z or -1) + u, i % 5) for i, (g, x, z, u) in enumerate(made)]
    df = spark.createDataFrame(made, "g string, x double, z double, t int, y double, fold int").repartition(4)
    shape = trees.Shape(trees=3 if task_cells else 10, depth=2, rate=0.3, min_leaf=5, loss=loss)
    target = "t" if loss == "logistic" else "y"
    models = {f"p{f}": (F.col(target), F.col("fold") != f) for f in (0, 1)}
    got = trees.fit_trees(df, ["x", "z"], models, ["g"], shape, task_cells).predict(df).toPandas()
    for g in ("a", "b"):
        d = got[got.g == g]
        X = np.where(np.isnan(d[["x", "z"]].to_numpy()), -1, d[["x", "z"]].to_numpy())
        for f in (0, 1):
            on = (d.fold != f).to_numpy()
            want = boosted(X[on], d[target].to_numpy(float)[on], shape, X)
            assert np.allclose(d[f"p{f}"], want, atol=1e-9)
    assert got[got.g.isna()].p0.notna().all()


def test_forest_and_jobs_do_not_grow_with_models(spark, data):
    shape = trees.Shape(trees=20, depth=4, loss="mean", share=0.5)
    one = {"a": (F.col("y"), F.col("t") == 1)}
    many = {f"m{k}": (F.col("y"), F.col("id") % 7 != k) for k in range(6)}
    few, n_few = jobs_of(spark, lambda: trees.fit_trees(data, ["x", "z"], one, ["g"], shape))
    wide, n_many = jobs_of(spark, lambda: trees.fit_trees(data, ["x", "z"], many, ["g"], shape))
    assert n_many <= n_few + 2
    p = wide.predict(data).toPandas()
    assert np.corrcoef(p.m0, p.y)[0, 1] > 0.8 and p.m0.notna().all()
    assert few.predict(data).where("a is null").isEmpty()
    again = trees.fit_trees(data.repartition(3), ["x", "z"], many, ["g"], shape).predict(data).orderBy("id").toPandas()
    assert np.allclose(again.m0, p.sort_values("id").m0)


def test_blocks_of_groups(spark, data, monkeypatch):
    shape = trees.Shape(trees=2, depth=2)
    models = {"p": (F.col("y"), F.lit(True))}
    whole = trees.fit_trees(data, ["x", "z"], models, ["g"], shape).predict(data).orderBy("id").toPandas()
    monkeypatch.setattr(trees, "SENT_NODES", 20)
    parts = trees.fit_trees(data, ["x", "z"], models, ["g"], shape)
    assert len(parts.parts) == 3 and np.allclose(parts.predict(data).orderBy("id").toPandas().p, whole.p)
    monkeypatch.setattr(logistic, "SENT_NUMBERS", 20)
    a = {r.g: r.coef for r in logistic.logistic_fit(data, "t", ["x"], ["g"]).collect()}
    monkeypatch.undo()
    b = {r.g: r.coef for r in logistic.logistic_fit(data, "t", ["x"], ["g"]).collect()}
    assert set(a) == set(b) and all(a[g] == pytest.approx(b[g]) for g in a)


@pytest.mark.parametrize("method", ["logistic", "gbm", "ensemble"])
def test_propensity_methods(spark, data, method):
    params = {} if method == "logistic" else dict(trees=5, depth=2)
    p = learners.propensity(data, "t", ["x", "z"], method, ["g"], key=["id"], **params).toPandas()
    assert len(p) == 900 and ((p.ps > 0) & (p.ps < 1)).all() and np.corrcoef(p.ps, p.t)[0, 1] > 0.3
    with pytest.raises(ValueError):
        learners.propensity(data, "t", ["x"], "magic")


@pytest.mark.parametrize("learner", ["gbt", "forest"])
def test_crossfit_with_trees(spark, data, learner):
    got = resample.crossfit_aipw(data, "t", "y", ["x", "z"], ["id"], learner=learner, trees=20, depth=3, rate=0.3, min_leaf=5, other_arm="full").first()
    assert got.n == 900 and abs(got.ate - 0.7) < 0.25 and 0.01 < got.se < 0.2
