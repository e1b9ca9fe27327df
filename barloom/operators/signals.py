"""Votes, regime gate, signal, trade levels, and the views on the newest signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, clip, filled, ratio, rolled, series
from ..settings import DEFAULTS, Settings


def _or(col, value: float) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(value))


def _sigma(col, n: int, least: int, keys) -> Column:
    """Rolling sample sigma, NULL when zero."""
    return F.nullif(rolled(F.stddev_samp, col, n, keys, least), F.lit(0.0))


def votes(df: DataFrame, keys=KEYS) -> DataFrame:
    """Score_Trend, Score_Momentum, Score_MeanRev and Score_Volume, each in [-1, 1]."""
    w = series(keys)
    macd = _or("MACD", 0.0)
    obv = _or(filled("OBV", None, keys), 0.0)
    df = df.select(
        "*",
        _sigma(F.col("MACD_Hist"), 20, 5, keys).alias("_hist_sd"),
        (macd - F.lag(macd, 3).over(w)).alias("_macd_slope"),
        obv.alias("_obv"),
    )
    df = df.withColumn("_slope", F.col("_obv") - F.lag("_obv", 10).over(w))
    df = df.withColumn("_slope_sd", _sigma(F.col("_slope"), 60, 10, keys))

    flag = lambda c: 2 * F.col(c).cast("double") - 1
    swing = _or(F.tanh(F.col("MACD_Hist") / F.col("_hist_sd")), 0.0)
    trend = (flag("MA20_above_MA50") + flag("MA50_above_MA200") + swing + flag("Close_above_MA200")) / 4

    rsi = _or("RSI_14", 50.0)
    health = F.when(rsi < 30, -1.0).when(rsi <= 70, (rsi - 50) / 20).otherwise(1 - (rsi - 70) / 30)
    drift = F.tanh(F.signum(macd) * 0.5 + _or("_macd_slope", 0.0) * 2)
    momentum = (health + drift + F.tanh(_or("ROC_10", 0.0) / 5)) / 3

    band = 1 - 2 * _or(clip(F.col("BB_Pct"), 0.0, 1.0), 0.5)
    stoch = 1 - 2 * ((_or("Stoch_K", 50.0) + _or("Stoch_D", 50.0)) / 200)
    reversion = (band + stoch) / 2

    flow = _or(F.tanh(F.col("_slope") / F.col("_slope_sd")), 0.0)
    surge = F.tanh(F.least(_or("Vol_Ratio", 1.0), F.lit(5.0)) - 1)
    volume = F.signum(_or("Return_5d", 0.0)) * (0.5 * flow + 0.5 * surge)

    scores = {"Score_Trend": trend, "Score_Momentum": momentum, "Score_MeanRev": reversion, "Score_Volume": volume}
    return df.withColumns({k: clip(v, -1.0, 1.0) for k, v in scores.items()}).drop(
        "_hist_sd", "_macd_slope", "_obv", "_slope", "_slope_sd"
    )


def composite(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    w = cfg.normalised_weights()
    return df.withColumn(
        "Score_Raw",
        w["trend"] * F.col("Score_Trend")
        + w["momentum"] * F.col("Score_Momentum")
        + w["mean_reversion"] * F.col("Score_MeanRev")
        + w["volume"] * F.col("Score_Volume"),
    )


def _gate(cfg: Settings, part: str) -> Column:
    """Gate value of the row's regime; an unknown regime uses the SIDEWAYS gate."""
    expr = F.lit(getattr(cfg.gates["SIDEWAYS"], part))
    for name, gate in cfg.gates.items():
        if name != "SIDEWAYS":
            expr = F.when(F.col("Regime_Label") == name, getattr(gate, part)).otherwise(expr)
    return expr


def gate(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Signal, Confidence, Size_Mult and Signal_Strength from the composite score and the regime."""
    buy, sell = _gate(cfg, "buy"), _gate(cfg, "sell")
    if cfg.soft_gate and "Regime_Prob_Bull" in df.columns:
        known = F.col("Regime_Prob_Bull").isNotNull()
        tilt = 0.10 * (F.col("Regime_Prob_Bull") - 0.5) * 2
        buy = F.when(known, F.greatest(F.lit(0.10), buy - tilt)).otherwise(buy)
        sell = F.when(known, F.greatest(F.lit(0.10), sell + tilt)).otherwise(sell)
    score = F.col("Score_Raw")
    df = df.withColumns(
        {
            "Signal": F.when(score >= buy, 1).when(score <= -sell, -1).otherwise(0).cast("int"),
            "Confidence": F.least(F.lit(1.0), F.abs(score)),
        }
    )
    strong = F.col("Confidence") >= 0.75
    return df.withColumns(
        {
            "Size_Mult": F.when(F.col("Signal") != 0, _gate(cfg, "size")).otherwise(0.0),
            "Signal_Strength": F.when(F.col("Signal") == 0, "Hold")
            .when(F.col("Signal") > 0, F.when(strong, "Strong Buy").otherwise("Buy"))
            .otherwise(F.when(strong, "Strong Sell").otherwise("Sell")),
        }
    )


def levels(df: DataFrame, stop=2.0, target_1=2.0, target_2=4.0) -> DataFrame:
    """Entry, stop and targets in ATR multiples; mirrored on a sell, flat on a hold."""
    c, reach = F.col("close"), _or("ATR_14", 0.0) * F.col("Signal")
    df = df.withColumns(
        {
            "Entry_Price": c,
            "Stop_Loss": c - stop * reach,
            "Target_1": c + target_1 * reach,
            "Target_2": c + target_2 * reach,
        }
    )
    reward = ratio(F.abs(F.col("Target_2") - c), F.abs(c - F.col("Stop_Loss")))
    return df.withColumn("Risk_Reward", F.coalesce(reward, F.lit(0.0)))


def signals(labelled: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    return levels(gate(composite(votes(labelled, keys), cfg), cfg))


# ---- views ----


def latest(df: DataFrame, required=("Signal",), keys=KEYS) -> DataFrame:
    """Newest row per key with all `required` columns present.

    The row without a follower: a window in the order the series already has, so nothing is sorted again.
    """
    follower = F.lead("date").over(series(keys))
    rows = df.dropna(subset=list(required)).withColumn("_next", follower)
    return rows.filter(F.col("_next").isNull()).drop("_next")


def buy_list(df: DataFrame, top: int = 10) -> DataFrame:
    """Instruments whose newest bar is a BUY, most confident first."""
    return latest(df).filter(F.col("Signal") == 1).orderBy(F.col("Confidence").desc(), "instrument").limit(top)


def signal_grid(df: DataFrame, days: int = 30, carry: int = 3) -> DataFrame:
    """instrument x newest `days` dates; a missing cell repeats the last known one for at most `carry` dates."""
    dates = df.filter(F.col("Signal").isNotNull()).select("date").distinct()
    recent = dates.orderBy(F.col("date").desc()).limit(days)
    cells = df.join(F.broadcast(recent), "date", "left_semi").select(
        "instrument", "date", "Signal", "Confidence", "Signal_Strength"
    )
    axis = recent.agg(F.collect_list("date")).scalar()  # at most `days` entries, one scalar subquery
    names = cells.filter(F.col("Signal").isNotNull()).select("instrument").distinct()
    grid = names.select("instrument", F.explode(axis).alias("date"))
    full = grid.join(cells, ["instrument", "date"], "left")
    return full.select(
        "instrument",
        "date",
        filled("Signal", carry).alias("Signal"),
        filled("Confidence", carry).alias("Confidence"),
        F.coalesce(filled("Signal_Strength", carry), F.lit("—")).alias("Signal_Strength"),
    )


# View name -> number of bars.
VIEWS = {"5D": 5, "1M": 22, "3M": 66, "6M": 132, "1Y": 252, "3Y": 756}


def view_slices(df: DataFrame, keys=KEYS) -> DataFrame:
    """Every bar tagged with the views it belongs to: (…, views ARRAY<STRING>)."""
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))
    newest = F.max("date").over(Window.partitionBy(*keys))
    df = df.withColumns({"_age": age, "_newest": newest})
    tags = [F.when(F.col("_age") <= n, name) for name, n in VIEWS.items()]
    tags += [F.when(F.year("date") == F.year("_newest"), "YTD"), F.lit("MAX")]
    return df.withColumn("views", F.array_compact(F.array(*tags))).drop("_age", "_newest")
