"""Indicators against pandas on planted series, and their invariances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.recurrence import BLOCK, linear
from barloom.operators.indicators import COLUMNS, indicators
from barloom.operators.returns import prepare
from barloom.settings import DEFAULTS
from barloom.sources.panels import BARS

from .bars import walk


def frame(spark, pdf):
    return spark.createDataFrame(pdf, BARS)


@pytest.fixture(scope="module")
def long_walk():
    return walk("A", 2600, 0)  # crosses two block borders of the recurrences


@pytest.fixture(scope="module")
def got(spark, long_walk):
    return indicators(prepare(frame(spark, long_walk))).orderBy("date").toPandas()


def close_to(actual, expected, tol=1e-9):
    a, e = actual.to_numpy(float), np.asarray(expected, float)
    assert (np.isnan(a) == np.isnan(e)).all()
    ok = ~np.isnan(e)
    np.testing.assert_allclose(a[ok], e[ok], rtol=tol, atol=1e-11)


def ema(x, n):
    return x.ewm(span=n, min_periods=n, adjust=False).mean()


def test_exponential_averages_and_macd(got, long_walk):
    c = long_walk["close"]
    close_to(got["EMA_12"], ema(c, 12))
    close_to(got["EMA_26"], ema(c, 26))
    macd = ema(c, 12) - ema(c, 26)
    close_to(got["MACD"], macd, 1e-7)
    close_to(got["MACD_Signal"], ema(macd, 9), 1e-7)


def test_rsi(got, long_walk):
    d = long_walk["close"].diff()
    up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-d).where(d < 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    close_to(got["RSI_14"], 100 - 100 / (1 + up / down))


def test_average_true_range_is_zero_before_its_seed(got, long_walk):
    p = long_walk["close"].shift()
    tr = pd.concat(
        [long_walk["high"] - long_walk["low"], (long_walk["high"] - p).abs(), (long_walk["low"] - p).abs()], axis=1
    ).max(axis=1)
    want = np.zeros(len(tr))
    want[13] = tr[:14].mean()
    for i in range(14, len(tr)):
        want[i] = (want[i - 1] * 13 + tr[i]) / 14
    close_to(got["ATR_14"], want)


def test_rolling_columns(got, long_walk):
    c, v = long_walk["close"], long_walk["volume"]
    close_to(got["MA_200"], c.rolling(200).mean())
    close_to(got["BB_Upper"], c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0))
    close_to(got["Volatility_20"], np.log(c / c.shift()).rolling(20).std() * np.sqrt(252), 1e-7)
    close_to(got["OBV"], np.where(c < c.shift(), -v, v).cumsum())
    low, high = long_walk["low"].rolling(14).min(), long_walk["high"].rolling(14).max()
    k = 100 * (c - low) / (high - low)
    close_to(got["Stoch_D"], k.rolling(3).mean())


def test_recurrence_carries_over_blocks(spark):
    n = 3 * BLOCK + 17
    df = spark.range(n).select(F.lit("A").alias("instrument"), F.col("id").alias("seq"), F.sin("id").alias("b"))
    got = linear(df, {"y": ("b", 0.93)}).orderBy("seq").toPandas()["y"].to_numpy()
    want, y = [], 0.0
    for b in np.sin(np.arange(n)):
        y = 0.93 * y + b
        want.append(y)
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-11)


def test_any_decay_is_exact(spark):
    n, b = 30_000, np.sin(np.arange(30_000))
    decays = {"tiny": 0.05, "small": 0.3, "common": 0.93, "ema200": 1 - 2 / 201, "wilder50": 49 / 50, "slow": 0.9999}
    df = spark.range(n).select(F.lit("A").alias("instrument"), F.col("id").alias("seq"), F.sin("id").alias("b"))
    got = linear(df, {k: ("b", q) for k, q in decays.items()}).orderBy("seq").toPandas()
    for k, q in decays.items():
        want, y = np.empty(n), 0.0
        for t in range(n):
            y = q * y + b[t]
            want[t] = y
        np.testing.assert_allclose(got[k], want, rtol=0, atol=1e-9)
    with pytest.raises(ValueError):
        linear(df, {"y": ("b", 1.0)})


def test_long_spans_of_the_indicators(spark, long_walk):
    cfg = DEFAULTS.with_(ema_slow=200, atr=50)
    got = indicators(prepare(frame(spark, long_walk)), cfg).orderBy("date").toPandas()
    assert got["EMA_26"].notna().sum() > 2000 and got["ATR_14"].notna().sum() > 2000



def test_unchanged_by_partitioning_and_by_other_instruments(spark):
    a, b = walk("A", 320, 1), walk("B", 260, 2)
    alone = indicators(prepare(frame(spark, a))).orderBy("date").toPandas()
    mixed = pd.concat([b, a]).sample(frac=1, random_state=3)
    both = indicators(prepare(frame(spark, mixed).repartition(7))).filter("instrument = 'A'").orderBy("date").toPandas()
    pd.testing.assert_frame_equal(alone[list(COLUMNS)], both[list(COLUMNS)], rtol=1e-12)


def test_one_shuffle_for_all_indicators(spark):
    plan = indicators(prepare(frame(spark, walk("A", 50, 1))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "ArrowEval" not in plan
