"""Regime labels: structure recovered on planted series, model invariants, fallbacks."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import regime as rg
from barloom.operators import regime_models as rm
from barloom.operators.indicators import indicators
from barloom.operators.returns import prepare
from barloom.sources.panels import BARS

from .bars import planted_regimes, walk


@pytest.fixture(scope="module")
def features(spark):
    return indicators(prepare(spark.createDataFrame(planted_regimes(), BARS))).cache()


def recall(df):
    pdf = df.orderBy("date").toPandas()
    return (pdf["Regime_Label"].iloc[300:410] == "BEAR").mean()


def test_hmm_finds_the_crash(features):
    assert recall(rg.hmm_regime(features)) > 0.6


def test_kmeans_labels_every_bar(features):
    pdf = rg.kmeans_regime(features).toPandas()
    assert pdf["Regime"].isin([0, 1, 2]).all()


def test_posteriors_and_transitions_are_probabilities(features):
    model, decoded = rg.decode_hmm(features)
    pdf = decoded.filter("_use").toPandas()
    np.testing.assert_allclose(pdf[["p0", "p1", "p2"]].sum(axis=1), 1.0, atol=1e-9)
    rows = rg.model_transitions(model, decoded).groupBy("from_regime").agg(F.sum("probability").alias("s")).toPandas()
    assert len(rows) == 3
    np.testing.assert_allclose(rows["s"], 1.0, atol=1e-9)


def loop_densities(x, means, covs):
    out = np.empty((len(x), 3))
    for k in range(3):
        z = np.linalg.solve(np.linalg.cholesky(covs[k]), (x - means[k]).T)
        out[:, k] = -0.5 * (z**2).sum(0) - 0.5 * np.linalg.slogdet(covs[k])[1] - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def loop_posteriors(logb, start, trans):
    """Posteriors, expected moves and log likelihood by the plain recursions."""
    b = np.exp(logb)
    alpha, scale = np.empty_like(b), np.empty(len(b))
    for t in range(len(b)):
        alpha[t] = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    beta = np.ones_like(b)
    for t in range(len(b) - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    g = alpha * beta
    moves = np.zeros((3, 3))
    for t in range(len(b) - 1):
        m = alpha[t][:, None] * trans * (b[t + 1] * beta[t + 1])[None]
        moves += m / m.sum()
    return g / g.sum(1, keepdims=True), moves, np.log(scale).sum()


def loop_path(logb, start, trans):
    score, back = np.log(start) + logb[0], []
    for t in range(1, len(logb)):
        cand = score[:, None] + np.log(trans)
        back.append(cand.argmax(0))
        score = cand.max(0) + logb[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def loop_lloyd(x):
    order = np.array(sorted(map(tuple, x)))
    centers = np.array([p.mean(0) for p in np.array_split(order, 3)])
    for _ in range(300):
        near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[near == k].mean(0) if (near == k).any() else centers[k] for k in range(3)])
        if np.abs(moved - centers).max() < 1e-10:
            return moved
        centers = moved
    return centers


def loop_fit(x, steps):
    means, covs = loop_lloyd(x), np.array([np.cov(x.T) + 0.01 * np.eye(x.shape[1])] * 3)
    start, trans, path = np.full(3, 1 / 3), np.full((3, 3), 1 / 3), []
    for _ in range(steps):
        g, moves, like = loop_posteriors(loop_densities(x, means, covs), start, trans)
        path.append(like)
        if len(path) > 1 and path[-1] - path[-2] < 1e-3:
            break
        w = g.sum(0) + 1e-12
        start, trans = g[0], (moves + 1e-12) / (moves + 1e-12).sum(1, keepdims=True)
        means = g.T @ x / w[:, None]
        covs = np.array([((g[:, k, None] * (x - means[k])).T @ (x - means[k]) + 0.01 * np.eye(x.shape[1])) / w[k] for k in range(3)])
    return start, trans, means, covs, path


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, s, (n, 3)) for m, s, n in ((0, 1, 60), (2, 0.5, 40), (-2, 0.8, 50))])
    x = (x - x.mean(0)) / x.std(0)
    rows = [("A", date(2020, 1, 1) + timedelta(days=k), *map(float, v)) for k, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "instrument string, date date, a double, b double, c double")


def as_model(frame):
    pdf = frame.orderBy("state").toPandas()
    covs = np.array(pdf["cov"].tolist()).reshape(3, 3, 3)
    return pdf["start"].to_numpy(), np.array(pdf["trans"].tolist()), np.array(pdf["mean"].tolist()), covs, pdf


def test_lloyd_equals_the_loop(spark, points):
    x, rows = points
    df = rows.withColumns({"_fit": F.lit(True), "_use": F.lit(True)})
    got = rm.cluster_states(df, ["a", "b", "c"]).orderBy("date").toPandas()["state"].to_numpy()
    centers = loop_lloyd(x)
    assert (got == ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()


def test_clusters_of_few_and_equal_points(spark):
    for values in ([1.0], [1.0, 1.0], [2.0, 1.0, 1.0, 1.0], []):
        rows = [("A", date(2020, 1, 1) + timedelta(days=k), v, k % 2 == 0, True) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "instrument string, date date, a double, _fit boolean, _use boolean")
        got = rm.cluster_states(df, ["a"]).collect()
        assert len(got) == len(values) and all(r.state in (0, 1, 2) for r in got)


@pytest.mark.parametrize("steps", [1, 4, 200])
def test_fit_equals_the_loop(points, steps):
    x, rows = points
    start, trans, mean, cov, pdf = as_model(rm.fit_hmm(rows, ["a", "b", "c"], steps=steps))
    want = loop_fit(x, steps)
    for got, w in zip((start, trans, mean, cov), want, strict=False):
        np.testing.assert_allclose(got, w, rtol=1e-6, atol=1e-8)
    assert pdf["log_likelihood"].iloc[0] == pytest.approx(want[-1][-1], rel=1e-9) and pdf["steps"].iloc[0] == len(want[-1])


def test_series_estimated_side_by_side_equal_the_loop(points, monkeypatch):
    x, _ = points
    cut = [x[a:b] for a, b in ((0, 150), (10, 90), (40, 150), (0, 60), (30, 150), (20, 80), (50, 130))]
    for together in (300, 100_000):  # newcomers join those at work, or all begin at once
        monkeypatch.setattr(rm, "SIDE_BY_SIDE", together)
        for part, got in zip(cut, rm._estimate(cut, 60, 1e-3), strict=True):
            want = loop_fit(part, 60)
            for a, b in zip(got[:4], want[:4], strict=True):
                np.testing.assert_allclose(np.reshape(a, np.shape(b)), b, rtol=1e-6, atol=1e-8)
            assert got[4] == pytest.approx(want[4][-1], rel=1e-9) and got[5] == len(want[4])


def test_likelihood_never_falls(points):
    _, rows = points
    path = [rm.fit_hmm(rows, ["a", "b", "c"], steps=n).first()["log_likelihood"] for n in (1, 2, 3, 5, 8, 13)]
    assert all(b > a - 0.05 for a, b in zip(path, path[1:], strict=False))  # the covariance floor may cost a little


def test_decoding_equals_the_loop(spark, points):
    x, rows = points
    given = {
        "start": [0.2, 0.5, 0.3], "trans": [0.8, 0.1, 0.1, 0.2, 0.7, 0.1, 0.1, 0.3, 0.6],
        "mean": [[-1, 0, 0.5], [0, 0.2, 0], [1, -0.4, 0.1]], "cov": [[1, 0.2, 0, 0.2, 1, 0.1, 0, 0.1, 0.7]] * 3,
    }
    df = rows.withColumns({"_fit": F.lit(True), "_use": F.lit(True)})
    model = rm.stated_model(df, ["a", "b", "c"], given)
    got = rm.decode(df, model, ["a", "b", "c"]).orderBy("date").toPandas()
    logb = loop_densities(x, np.array(given["mean"], float), np.array(given["cov"], float).reshape(3, 3, 3))
    trans = np.array(given["trans"]).reshape(3, 3)
    np.testing.assert_allclose(got[["p0", "p1", "p2"]].to_numpy(), loop_posteriors(logb, np.array(given["start"]), trans)[0], atol=1e-9)
    assert got["state"].tolist() == loop_path(logb, np.array(given["start"]), trans)
    plan = rm.decode(df, model, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_decoding_long_series_and_packing_only_its_columns(spark, points):
    x, rows = points
    given = {
        "start": [0.2, 0.5, 0.3], "trans": [0.8, 0.1, 0.1, 0.2, 0.7, 0.1, 0.1, 0.3, 0.6],
        "mean": [[-1, 0, 0.5], [0, 0.2, 0], [1, -0.4, 0.1]], "cov": [[1, 0.2, 0, 0.2, 1, 0.1, 0, 0.1, 0.7]] * 3,
    }
    df = rows.withColumns({"_fit": F.lit(True), "_use": F.col("date") != F.lit("2020-02-01").cast("date"), "other": F.lit("carried")})
    decoded = rm.decode(df, rm.stated_model(df, ["a", "b", "c"], given), ["a", "b", "c"])
    got = decoded.orderBy("date").toPandas()
    use = got["_use"].to_numpy()
    logb = loop_densities(x[use], np.array(given["mean"], float), np.array(given["cov"], float).reshape(3, 3, 3))
    assert got["state"][use].astype(int).tolist() == loop_path(logb, np.array(given["start"]), np.array(given["trans"]).reshape(3, 3))
    assert got["state"][~use].isna().all() and (got["other"] == "carried").all()
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert all("other" not in line for line in plan.splitlines() if "collect_list" in line)


def test_moves_that_cannot_happen_and_single_rows(spark):
    given = {"start": [1, 0, 0], "trans": [0.5, 0.5, 0, 0, 1, 0, 0, 0, 1], "mean": [[0], [0], [0]], "cov": [[1], [1], [1]]}
    rows = [("A", date(2020, 1, k), float(k % 3), True, True) for k in range(1, 8)] + [("B", date(2020, 1, 1), 1.0, True, True), ("C", date(2020, 1, 1), 1.0, False, False)]
    df = spark.createDataFrame(rows, "instrument string, date date, a double, _fit boolean, _use boolean")
    got = rm.decode(df, rm.stated_model(df, ["a"], given), ["a"]).orderBy("instrument", "date").toPandas()
    assert set(got["state"].dropna()) <= {0, 1} and got["state"].iloc[0] == 0 and got["state"].iloc[7] == 0
    assert got["p2"].dropna().eq(0).all() and pd.isna(got["state"].iloc[8])


def test_short_series_keep_the_rule(spark):
    short = indicators(prepare(spark.createDataFrame(walk("S", 90, 3), BARS)))
    got = rg.hmm_regime(short).orderBy("date").toPandas()
    rule = rg.rule_regime(short).orderBy("date").toPandas()
    assert (got["Regime"] == rule["Regime"]).all()
    assert got["Regime_Prob_Bull"].isna().all()


def test_causal_leaves_the_warm_up_unfilled(features):
    full = rg.hmm_regime(features).orderBy("date").toPandas()
    causal = rg.hmm_regime(features, causal=True).orderBy("date").toPandas()
    assert full["Regime"].notna().all()
    assert causal["Regime_Prob_Bull"].iloc[:15].isna().all()


def test_training_rows_alone_decide_the_model(spark, features):
    cut = F.col("date") < F.lit("2018-12-01").cast("date")
    tagged = features.withColumn("is_train", cut)
    model, _ = rg.decode_hmm(tagged, train=F.col("is_train"))
    alone, _ = rg.decode_hmm(features.filter(cut))
    a = model.orderBy("state").toPandas()["mean"].tolist()
    b = alone.orderBy("state").toPandas()["mean"].tolist()
    np.testing.assert_allclose(np.array(a), np.array(b), atol=1e-9)


def test_squeeze_equals_pandas_quantile(spark):
    df = indicators(prepare(spark.createDataFrame(walk("Q", 700, 9), BARS)))
    got = rg.squeezed(df).orderBy("date").toPandas()
    cut = got["BB_Width"].rolling(252, min_periods=60).quantile(0.2)
    assert (got["squeezed"] == (got["BB_Width"] < cut)).all()


@pytest.mark.parametrize("given", [None, {"start": [0.2, 0.5, 0.3], "trans": [0.8, 0.2, 0, 0.2, 0.7, 0.1, 0.1, 0.3, 0.6], "mean": [[-1, 0, 0.5], [0, 0.2, 0], [1, -0.4, 0.1]], "cov": [[1, 0.2, 0, 0.2, 1, 0.1, 0, 0.1, 0.7]] * 3}])
def test_labels_in_one_pass_equal_the_model_table_and_its_decoding(spark, given):
    bars = spark.createDataFrame(pd.concat([walk("A", 400, 3), walk("B", 250, 4), walk("C", 60, 5)]), BARS)
    tagged = indicators(prepare(bars)).withColumn("is_train", F.dayofyear("date") < 200).cache()
    got = rg.hmm_regime(tagged, train=F.col("is_train"), parameters=given).orderBy("instrument", "date")
    _, decoded = rg.decode_hmm(tagged, train=F.col("is_train"), parameters=given)
    ranked = rg.order_posteriors(rg.order_states(decoded, train=F.col("_fit"))).drop("state", "p0", "p1", "p2")
    want = rg.model_or_rule(rg.spread_both(ranked)).select(*got.columns).orderBy("instrument", "date").toPandas()
    pd.testing.assert_frame_equal(got.toPandas(), want, check_dtype=False, rtol=1e-6, atol=1e-8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan
