"""Detector building blocks on small fixtures."""

import numpy as np
import pytest

from vigil.operators import detectors as det


def test_mixture_separates_binary_input(spark):
    rows = [(float(v),) for v in [0] * 85 + [1] * 15]
    df = spark.createDataFrame(rows, "x double")
    w, means, covs = det.fit_mixture(df, ["x"], 2)[:3]
    got = sorted(float(m[0]) for m in means)
    assert abs(got[0] - 0.0) < 1e-6 and abs(got[1] - 1.0) < 1e-6
    assert abs(sorted(w)[0] - 0.15) < 1e-6


def test_mixture_two_clusters_2d(spark):
    rng = np.random.default_rng(0)
    a = rng.normal([0, 0], 0.3, (60, 2))
    b = rng.normal([5, 5], 0.3, (40, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.vstack([a, b])], "x double, y double")
    w, means, covs = det.fit_mixture(df, ["x", "y"], 2)[:3]
    centers = sorted((round(float(m[0])), round(float(m[1]))) for m in means)
    assert centers == [(0, 0), (5, 5)]
    comp = df.withColumn("c", det.mixture_component(["x", "y"], w, means, covs))
    assert comp.select("c").distinct().count() == 2


def test_oversample_and_sequences(spark):
    import datetime as dt
    rows = [("U", dt.date(2020, 1, 1) + dt.timedelta(days=i), i % 4 == 0, float(i))
            for i in range(15)]
    df = spark.createDataFrame(rows, "universe string, date date, yb boolean, a double")
    df = df.selectExpr("universe", "date", "CAST(yb AS INT) AS y", "a")
    assert det.oversample(df).count() == 15 + 10 * 4
    seq = det.sequences(df, ["a"], seq_len=10).orderBy("date").collect()
    assert seq[9]["seq"] is None and seq[10]["seq"] == [[float(i)] for i in range(10)]


def labelled(spark, days=260, universes=2):
    import datetime as dt
    rng = np.random.default_rng(3)
    rows = []
    for u in range(universes):
        score = 60 + 6 * np.sin(np.arange(days) / 9) + rng.normal(0, 1, days)
        for i in range(days):
            low = float(score[i])
            rows.append((f"U{u}", dt.date(2020, 1, 1) + dt.timedelta(days=i), low, float(rng.normal()),
                         None if i % 17 == 0 else float(abs(rng.normal()) + (low < 55)),
                         -abs(float(rng.normal())), float(rng.normal(15, 3)), float(rng.normal()),
                         int(low < 57), "train" if i < 180 else "test"))
    return spark.createDataFrame(rows, "universe string, date date, risk_score double, risk_velocity double, vol_20d "
                                 "double, max_drawdown double, vix_level double, bank_market_corr double, y int, part string")


def rows_of(df):
    return {(r["universe"], r["date"]): (r["pred"], None if r["proba"] is None else round(r["proba"], 12))
            for r in df.collect()}


def test_saved_detectors_predict_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel
    data = labelled(spark).cache()
    made = {"scaled": det.logistic(data)[:2], "cut": det.logistic(data, scale=False, cut=0.55)[:2],
            "forest": det.random_forest(data, n_trees=5)[:2],
            "history": det.sequence_perceptron(data, seq_len=4, hidden=4, max_iter=20)[:2]}
    for name, (fresh, fitted) in made.items():
        fitted.write().overwrite().save(str(tmp_path / name))
        back = PipelineModel.load(str(tmp_path / name))
        want = rows_of(fresh)
        assert len(want) == 160 and rows_of(det.predictions(back, data, name)) == want
        assert {p for p, _ in want.values()} == {0, 1}, name
    first = data.where("date < '2020-01-04'").withColumn("part", det.F.lit("test"))
    lone = det.predictions(PipelineModel.load(str(tmp_path / "history")), first, "m").collect()
    assert all(r["pred"] == 0 and r["proba"] is None for r in lone)  # no history yet


def test_isolation_forest_finds_outliers_and_survives_saving(spark, tmp_path):
    from vigil.operators import isolation
    data = labelled(spark).withColumn(
        "vix_level", det.F.when(det.F.col("date") == "2020-08-01", 90.0).otherwise(det.F.col("vix_level"))).cache()
    preds, fitted = det.isolation_forest(data, n_trees=40, sample=64)
    got = rows_of(preds)
    top = max(got, key=lambda k: got[k][1])
    assert str(top[1]) == "2020-08-01" and got[top][0] == 1 and 0 <= min(v[1] for v in got.values())
    nodes = fitted.nodes.toPandas()
    assert nodes["tree"].nunique() == 40 and (nodes["node"] < 2 ** 7).all()
    inner = nodes[nodes["feature"] >= 0]
    kids = set(zip(nodes["tree"], nodes["node"]))
    assert all((t, 2 * n + 1) in kids and (t, 2 * n + 2) in kids for t, n in zip(inner["tree"], inner["node"]))
    fitted.save(str(tmp_path / "forest"))
    back = isolation.IsolationForest.load(spark, str(tmp_path / "forest"))
    assert rows_of(back.score(data.where("part = 'test'"), "universe", "date")) == got


def test_isolation_paths_equal_a_walk(spark):
    from vigil.operators import isolation
    rows = [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    nodes = isolation.grow(isolation.sampled(df, 60, 6, 20, 1, "k"), 2, 4, 1)
    table = {(r["tree"], r["node"]): (r["feature"], r["value"]) for r in nodes.collect()}

    def walk(t, x):
        n = 0
        while table[t, n][0] >= 0:
            f, cut = table[t, n]
            n = 2 * n + 1 + int(x[f] >= cut)
        return table[t, n][1]

    got = {r["k"]: r["path"] for r in isolation.paths(df, nodes, 6, 4, "k").collect()}
    for k, x in rows:
        assert abs(got[k] - sum(walk(t, x) for t in range(6)) / 6) < 1e-9


def test_exact_quantile(spark):
    from vigil.operators import isolation
    rng = np.random.default_rng(5)
    for xs in ([3.0], [1.0, 2.0], list(rng.normal(size=101)) + [0.5] * 30):
        df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert abs(isolation.quantile(df, "x", q) - np.quantile(xs, q)) < 1e-12
    assert isolation.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None


def test_walk_forward_folds_train_before_their_days(spark, tmp_path):
    data = labelled(spark, 200)
    out = det.walk_forward(data, stride=20, min_train=60, train_window=90, n_trees=3, max_depth=3,
                           path=str(tmp_path / "wf"))
    assert out.count() == 2 * 140  # days 60 ... 199, every fold had positives
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    rows, days = det.fold_rows(data, 20, 60, 3)
    train = det.fold_training(rows, days, 20, 60, 90).select("day", "train_fold", "label_end").toPandas()
    start = 60 + 20 * train["train_fold"]
    assert ((train["day"] < start) & (train["day"] >= start - 90)).all()
    last = {r["day"]: r["date"] for r in days.collect()}
    assert all(e < last[s] for e, s in zip(train["label_end"], start))
    assert sorted(train["train_fold"].unique()) == list(range(7))


def plain_mixture(x, k, steps, reg=1e-3):
    """EM over one array, from the same start."""
    d = x.shape[1]
    cov0 = np.cov(x.T, bias=True).reshape(d, d) + reg * np.eye(d)
    means = np.repeat(x.mean(axis=0)[None], k, axis=0)
    means[:, 0] = np.linspace(x[:, 0].min(), x[:, 0].max(), k)
    covs, weights = [cov0] * k, np.full(k, 1 / k)
    for _ in range(steps):
        dens = []
        for j in range(k):
            dev = x - means[j]
            quad = np.array([v @ np.linalg.inv(covs[j]) @ v for v in dev])
            dens.append(weights[j] * np.exp(-quad / 2) / np.sqrt(np.linalg.det(2 * np.pi * covs[j])))
        r = np.array(dens) / np.sum(dens, axis=0)
        weights = r.sum(axis=1) / len(x)
        means = np.array([(r[j][:, None] * x).sum(axis=0) / r[j].sum() for j in range(k)])
        covs = [(r[j][:, None, None] * np.array([np.outer(v, v) for v in x])).sum(axis=0) / r[j].sum()
                - np.outer(means[j], means[j]) + reg * np.eye(d) for j in range(k)]
    return weights, means, np.array(covs), float(np.log(np.sum(dens, axis=0)).sum())


def test_mixture_steps_cost_their_rows_not_their_partitions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal([0, 0, 1], 1.0, (150, 3)), rng.normal([3, -2, 1], 0.7, (90, 3))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(48)
    sc, steps = spark.sparkContext, 12

    def tasks_of(max_iter):
        group = f"mixture-{max_iter}"
        sc.setJobGroup(group, group)
        fit = det.fit_mixture(df, ["a", "b", "c"], 2, max_iter=max_iter, tol=0.0)
        sc.setLocalProperty("spark.jobGroup.id", None)
        tell = sc.statusTracker()
        jobs = [tell.getJobInfo(j) for j in tell.getJobIdsForGroup(group)]
        return fit, sum(tell.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if tell.getStageInfo(s))

    _, once = tasks_of(1)
    fit, often = tasks_of(steps)
    assert often - once < 48 * (steps - 1)  # a later step reads blocks, not the 48 partitions and what lies before
    weights, means, covs, ll = plain_mixture(x, 2, steps)
    assert np.allclose(fit.weights, weights) and np.allclose(fit.means, means) and np.allclose(fit.covariances, covs)
    assert abs(fit.log_likelihood - ll) < 1e-8 * abs(ll) and (fit.iterations, fit.converged) == (steps, False)
    monkeypatch.setattr(det, "BLOCK_ROWS", 7)  # many blocks, rows with a NULL left out of the sums
    more = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0)], df.schema))
    many = det.fit_mixture(more, ["a", "b", "c"], 2, max_iter=1)
    one = plain_mixture(x, 2, 1)
    assert many.weights.sum() * 241 == pytest.approx(240) and many.log_likelihood < 0
    assert np.isfinite(many.means).all() and np.asarray(many.means).shape == one[1].shape


def test_regime_series_are_smoothed_once(spark):
    data = labelled(spark)
    preds, states, _ = det.regime_model(data, binarise_below=57.0)
    plan = preds._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan  # the passes over the series are not run again for the output
    assert preds.count() == data.where("part = 'test'").count() and states.where("is_crisis").count() == 1
    assert preds.where("pred = 1").agg({"y": "avg"}).first()[0] > preds.where("pred = 0").agg({"y": "avg"}).first()[0]
