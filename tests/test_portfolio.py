"""Portfolio risk against NumPy on a planted panel, including a book larger than one pair block."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.skew import salted_join
from barloom.operators import portfolio as pf

DAYS = 80


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    names = [f"i{k:03d}" for k in range(150)]
    market = rng.normal(0, 0.01, DAYS)
    r = market[:, None] * rng.uniform(0.2, 1.5, 150) + rng.normal(0, 0.008, (DAYS, 150))
    days = pd.bdate_range("2020-01-01", periods=DAYS).date
    panel = pd.DataFrame(r, columns=names).assign(date=days).melt("date", var_name="instrument", value_name="Adj_Return")
    books = {"big": names, "small": names[:3], "one": names[:1]}
    held = pd.DataFrame(
        [(b, n, float(rng.integers(1, 100) * 1000)) for b, members in books.items() for n in members],
        columns=["portfolio_id", "instrument", "amount"],
    )
    returns = spark.createDataFrame(panel).cache()
    weighted, _ = pf.weigh(spark.createDataFrame(held))
    return r, names, held, returns, weighted.cache()


def weights(held, book):
    a = held[held.portfolio_id == book].set_index("instrument")["amount"]
    return (a / a.sum()).sort_index().to_numpy()


def test_covariance_of_a_book_over_several_blocks(data):
    r, names, held, returns, weighted = data
    got = pf.matrices(pf.aligned_panel(weighted, returns)).filter("portfolio_id = 'big'").toPandas()
    assert len(got) == 150 * 151 // 2 and not got.duplicated(["i", "j"]).any()
    at = {n: k for k, n in enumerate(names)}
    cov, corr = np.cov(r.T) * 252, np.corrcoef(r.T)
    i, j = got.i.map(at).to_numpy(), got.j.map(at).to_numpy()
    np.testing.assert_allclose(got["cov"], cov[i, j], rtol=1e-9, atol=1e-14)
    np.testing.assert_allclose(got["corr"], corr[i, j], rtol=1e-9, atol=1e-12)


def test_holdings_of_the_matrices_are_put_together_once(data):
    _, _, _, returns, weighted = data
    plan = pf.matrices(pf.aligned_panel(weighted, returns))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "windowspecdefinition" not in plan  # neither side works them out again


def test_days_travel_packed_and_large_books_in_parts(data, monkeypatch):
    _, _, _, returns, weighted = data
    plan = pf.book_series(weighted, returns)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "date" in line for line in plan.splitlines())
    whole = {(r.portfolio_id, r.date): r.port_log for r in pf.book_series(weighted, returns).collect()}
    monkeypatch.setattr(pf, "LARGE_BOOK", 2)
    parts = {(r.portfolio_id, r.date): r.port_log for r in pf.book_series(weighted, returns).collect()}
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)


@pytest.mark.parametrize("references", [1, pf.REFERENCES])
def test_threshold_join_loses_no_pair(data, references):
    r, names, held, returns, weighted = data
    series = pf.held_series(pf.aligned_panel(weighted, returns))
    corr = np.corrcoef(r.T)
    for least in (0.3, 0.75):
        got = pf.correlated_pairs(series, least, references=references).toPandas()
        want = {("big", names[i], names[j]) for i in range(150) for j in range(i + 1, 150) if corr[i, j] > least}
        want |= {("small", names[i], names[j]) for i in range(3) for j in range(i + 1, 3) if corr[i, j] > least}
        assert set(zip(got.portfolio_id, got.i, got.j, strict=True)) == want and len(got) == len(want)
        at = {n: k for k, n in enumerate(names)}
        np.testing.assert_allclose(got["corr"], corr[got.i.map(at), got.j.map(at)], rtol=1e-9)


def test_threshold_join_measures_few_pairs_of_a_large_book(spark):
    """A thousand names in forty groups, all moved by one market; two names never move and have no correlation."""
    rng = np.random.default_rng(12)
    n, groups, days = 1000, 40, 120
    common, own = rng.normal(0, 1, (groups, days)), rng.normal(0, 1, (n, days))
    r = np.sqrt(0.25) * rng.normal(0, 1, days) + np.sqrt(0.6) * common[np.arange(n) % groups] + np.sqrt(0.15) * own
    r[7] = r[500] = 0.0
    names = [f"n{k:04d}" for k in range(n)]
    dates = pd.bdate_range("2021-01-01", periods=days).date
    panel = pd.DataFrame(r.T, columns=names).assign(date=dates).melt("date", var_name="instrument", value_name="r")
    panel = panel.assign(portfolio_id="b", weight=1 / n, n_holdings=n, port_log=np.tile(r.mean(0), n))
    held = pf.held_series(spark.createDataFrame(panel)).cache()
    pairs = n * (n - 1) // 2
    assert pf.close_pairs(held, 0.75).count() < pairs / 2
    got = pf.correlated_pairs(held, 0.75).select("i", "j").toPandas()
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.corrcoef(r)
    i, j = np.nonzero(np.triu(np.nan_to_num(corr), 1) > 0.75)
    assert len(i) > 5000 and set(zip(got.i, got.j, strict=True)) == {(names[a], names[b]) for a, b in zip(i, j, strict=True)}


@pytest.mark.parametrize("book", ["big", "small", "one"])
def test_risk_parts_add_up_to_sigma(data, book):
    r, names, held, returns, weighted = data
    w = weights(held, book)
    x = r[:, : len(w)]
    sigma = np.sqrt(w @ np.atleast_2d(np.cov(x.T)) @ w * 252)
    parts = pf.risk_contributions(pf.holding_stats(pf.aligned_panel(weighted, returns))).filter(F.col("portfolio_id") == book).toPandas()
    assert parts.risk_contribution.sum() == pytest.approx(sigma)
    assert parts.risk_contribution_pct.sum() == pytest.approx(1)
    m = pf.book_metrics(weighted, returns).filter(F.col("portfolio_id") == book).collect()[0]
    assert m["ann_vol"] == pytest.approx(sigma)
    simple = np.expm1(x @ w)
    curve = np.cumprod(1 + simple)
    assert m["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())


def test_mean_correlation_without_pairs(data):
    r, names, held, returns, weighted = data
    got = {x.portfolio_id: x.mean_pairwise_correlation for x in pf.mean_correlation(pf.aligned_panel(weighted, returns)).collect()}
    c = np.corrcoef(r.T)
    assert got["big"] == pytest.approx(c[~np.eye(150, dtype=bool)].mean())
    assert got["one"] is None


def test_mean_correlation_moves_no_rows_of_ordinary_books(data, monkeypatch):
    r, names, held, returns, weighted = data
    aligned = pf.aligned_panel(weighted, returns)
    before = aligned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    one = pf._mean_correlation(aligned, (*pf.BOOK, "_part"))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == before + 1  # a row per book
    monkeypatch.setattr(pf, "LARGE_BOOK", 100)  # the big book's years now lie in different tasks
    got = {x.portfolio_id: x.mean_pairwise_correlation for x in pf.mean_correlation(pf.aligned_panel(weighted, returns)).collect()}
    c = np.corrcoef(r.T)
    assert got["big"] == pytest.approx(c[~np.eye(150, dtype=bool)].mean())
    small = np.corrcoef(r[:, :3].T)
    assert got["small"] == pytest.approx(small[~np.eye(3, dtype=bool)].mean()) and got["one"] is None and len(got) == 3


def test_value_at_risk_is_the_linear_percentile(data):
    r, names, held, returns, weighted = data
    w = weights(held, "small")
    simple = np.expm1(r[:, :3] @ w)
    row = pf.value_at_risk(weighted, returns).filter("portfolio_id = 'small'").collect()[0]
    v = np.percentile(simple, 5)
    assert row["var_95_pct"] == pytest.approx(v) and row["cvar_95_pct"] == pytest.approx(simple[simple <= v].mean())


def test_bad_amounts_reject_the_whole_book(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", -1.0), ("b", "x", 2.0)], "portfolio_id string, instrument string, amount double")
    good, bad = pf.weigh(df)
    assert [r.portfolio_id for r in good.collect()] == ["b"] and [r.portfolio_id for r in bad.collect()] == ["a"]


def test_too_few_common_days_give_no_report(spark, data):
    _, names, held, returns, weighted = data
    late = returns.filter((F.col("instrument") != names[1]) | (F.col("date") > F.lit("2020-04-01").cast("date")))
    books = {r.portfolio_id for r in pf.book_metrics(weighted, late).collect()}
    assert books == {"one"}
    assert {r.portfolio_id for r in pf.long_enough(pf.aligned_panel(weighted, late)).select("portfolio_id").distinct().collect()} == {"one"}


def test_salted_join_is_an_inner_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").cast("string").alias("p"))
    few = spark.range(200).select(F.when(F.col("id") < 5, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 60)).alias("k"), "id")
    got = salted_join(many, few, "k", "p", rows_per_salt=100)
    want = many.join(few, "k")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_marking_prefers_shares_then_scaling_then_the_amount(spark):
    held = spark.createDataFrame(
        [("p", "a", 100.0, 2.0), ("p", "b", 100.0, None), ("p", "c", 100.0, 1.0), ("q", "c", 50.0, 1.0)],
        "portfolio_id string, instrument string, amount double, quantity double",
    )
    quotes = spark.createDataFrame([("a", 60.0, False), ("b", 22.0, False), ("c", 1.0, True)], "instrument string, last_price double, stale boolean")
    closes = spark.createDataFrame([("a", 50.0), ("b", 20.0), ("c", 1.0)], "instrument string, close double")
    got = {r.portfolio_id: r for r in pf.live_value(pf.mark_to_market(held, quotes, closes)).collect()}
    assert got["p"].live_value == pytest.approx(120 + 110 + 100) and got["p"].delta == pytest.approx(30)
    assert got["q"].live_value is None and got["q"].delta == 0
