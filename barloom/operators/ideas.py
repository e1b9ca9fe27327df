"""Ranked ideas and exit alerts from the newest bar of every instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, ratio
from ..functions.lineage import settle
from ..settings import DEFAULTS, Settings
from .signals import latest

# Regime bonus, conviction sizes and regime haircuts.
REGIME_BONUS = {"BULL": 1.0, "SIDEWAYS": 0.5, "BEAR": 0.0}
CONVICTION_SIZE = {"High": 0.10, "Medium": 0.06, "Low": 0.03}
REGIME_SIZE = {"BULL": 1.0, "SIDEWAYS": 0.7, "BEAR": 0.5}
STARS = {"High": "★★★", "Medium": "★★☆", "Low": "★☆☆"}
RANK = {"High": 3, "Medium": 2, "Low": 1}


def _lookup(col, table: dict, default) -> Column:
    expr = F.lit(default)
    for key, value in table.items():
        expr = F.when(F.col(col) == key, F.lit(value)).otherwise(expr)
    return expr


def snapshot(signals: DataFrame) -> DataFrame:
    """Newest bar per instrument with a close, an RSI and a long average."""
    return latest(signals, ("close", "RSI_14", "MA_200")).withColumnRenamed("date", "as_of")


def rsi_score(rsi: Column) -> Column:
    """Triangle over 30..80 with its peak at 55."""
    return (
        F.when((rsi >= 30) & (rsi <= 55), (rsi - 30) / 25)
        .when((rsi > 55) & (rsi <= 80), (80 - rsi) / 25)
        .otherwise(0.0)
    )


def trend_quality(dist: Column) -> Column:
    """Trapezoid: up to 5 % above the long average rising, flat to 20 %, falling to 40 %."""
    return (
        F.when(dist.isNull() | (dist < 0), 0.0)
        .when(dist < 0.05, dist / 0.05)
        .when(dist <= 0.20, 1.0)
        .when(dist <= 0.40, (0.40 - dist) / 0.20)
        .otherwise(0.0)
    )


def short_score() -> Column:
    floor0 = lambda c: F.greatest(c, F.lit(0.0))
    return (
        0.30 * floor0(F.tanh(F.col("Return_20d") / 0.20))
        + 0.25 * clip(F.col("Confidence"), 0.0, 1.0)
        + 0.20 * rsi_score(F.col("RSI_14"))
        + 0.15 * floor0(F.tanh(F.coalesce("Vol_Ratio", F.lit(1.0)) - 1))
        + 0.10 * _lookup("Regime_Label", REGIME_BONUS, 0.0)
    )


def agreement() -> Column:
    """How many of the trend, momentum and volume votes lean up."""
    lean = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) > 0.05).cast("int")
    return lean("Score_Trend") + lean("Score_Momentum") + lean("Score_Volume")


def short_eligible(cfg: Settings = DEFAULTS) -> Column:
    test = (
        (F.col("Signal") >= 0)
        & (F.col("Confidence") >= cfg.confidence_floor)
        & (F.col("Return_20d") > 0)
        & F.col("Regime_Label").isin("SIDEWAYS", "BULL")
        & (short_score() >= cfg.score_floor)
        & (agreement() >= cfg.min_agreement)
    )
    return F.coalesce(test, F.lit(False))


def long_score() -> Column:
    vol = F.col("Volatility_20")
    return (
        0.25 * F.col("Close_above_MA200")
        + 0.25 * clip(1 - vol / 0.45, 0.0, 1.0)
        + 0.20 * trend_quality(F.col("Dist_from_MA200_pct"))
        + 0.15 * clip(F.col("Confidence"), 0.0, 1.0)
        + 0.15 * F.least(F.greatest(F.col("Return_20d"), F.lit(0.0)) / 0.15, F.lit(1.0))
    )


def long_eligible() -> Column:
    test = (
        (F.col("Close_above_MA200") == 1)
        & (F.col("Signal") >= 0)
        & (F.col("Regime_Label") == "BULL")
        & (F.col("Volatility_20") < 0.45)
    )
    return F.coalesce(test, F.lit(False))


def conviction() -> Column:
    s, a, c = F.col("Score"), F.col("Engine_Agreement"), F.col("Confidence")
    return (
        F.when((s >= 0.45) & (a >= 3) & (c >= 0.38), "High").when((s >= 0.32) & (a >= 2), "Medium").otherwise("Low")
    )


def suggested_weight(cap: float = 0.10) -> Column:
    base = _lookup("Conviction", CONVICTION_SIZE, 0.03) * _lookup("Regime_Label", REGIME_SIZE, 0.7)
    return F.bround(F.least(base, F.lit(cap)), 4)


def holding_period(kind: str) -> Column:
    vol = F.col("Volatility_20")
    steps = {
        "short": (0.35, "6–8 weeks", "4–6 weeks", "2–4 weeks"),
        "long": (0.30, "12–18 months", "6–12 months", "3–6 months"),
    }
    upper, calm, middle, wild = steps[kind]
    return F.when(vol.isNull() | (vol < 0.20), calm).when(vol < upper, middle).otherwise(wild)


def _sentence(*bits: Column) -> Column:
    return F.concat(F.concat_ws("; ", *bits), F.lit("."))


def rationale_short() -> Column:
    rsi, vr = F.col("RSI_14"), F.col("Vol_Ratio")
    return _sentence(
        F.format_string("20-day return %+.1f%%", F.col("Return_20d") * 100),
        F.when((rsi >= 50) & (rsi <= 65), F.format_string("RSI %.0f (healthy momentum)", rsi)).when(
            rsi > 65, F.format_string("RSI %.0f (strong, watch overbought)", rsi)
        ),
        F.when(vr > 1.5, F.format_string("volume %.1f× avg confirms", vr)),
        F.when(F.col("Regime_Label") == "BULL", "bullish regime tailwind"),
    )


def rationale_long() -> Column:
    vol = F.col("Volatility_20")
    return _sentence(
        F.format_string("%+.1f%% above MA200", F.col("Dist_from_MA200_pct") * 100),
        F.when(vol < 0.20, F.format_string("low annualised vol (%.0f%%)", vol * 100)).when(
            vol < 0.30, F.format_string("moderate vol (%.0f%%)", vol * 100)
        ),
        F.lit("bullish regime"),
    )


def _entry_levels(df: DataFrame) -> DataFrame:
    """Entry band and ATR levels for every candidate, held or not."""
    c, atr = F.col("close"), F.coalesce("ATR_14", F.lit(0.0))
    df = df.withColumns(
        {
            "Entry_Low": c * (1 - 0.005),
            "Entry_High": c * (1 + 0.005),
            "Stop_Loss": c - 2 * atr,
            "Target_1": c + 2 * atr,
            "Target_2": c + 4 * atr,
        }
    )
    reward = ratio(F.abs(F.col("Target_2") - c), F.abs(c - F.col("Stop_Loss")))
    return df.withColumn("Risk_Reward", F.coalesce(reward, F.lit(0.0)))


IDEA = [
    "instrument", "Type", "Score", "Conviction", "Conviction_Stars", "conv_rank", "Engine_Agreement",
    "Suggested_Weight", "Signal_Strength", "Confidence", "close", "Entry_Low", "Entry_High", "Stop_Loss", "Target_1",
    "Target_2", "Risk_Reward", "Holding_Period", "RSI_14", "Volatility_20", "Regime_Label", "Rationale", "as_of",
]


SHORT, LONG = "Short-Term", "Long-Term"


def ideas(snap: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Short-term and long-term ideas in one pass.

    A name on the short list never appears on the long one; both tests read the same row, so the exclusion
    needs no join.
    """
    short = F.col("Type") == SHORT
    df = snap.withColumn("Type", F.when(short_eligible(cfg), SHORT).when(long_eligible(), LONG))
    df = df.filter(F.col("Type").isNotNull()).withColumns(
        {
            "Score": F.when(short, short_score()).otherwise(long_score()),
            "Engine_Agreement": agreement(),
            "Holding_Period": F.when(short, holding_period("short")).otherwise(holding_period("long")),
            "Rationale": F.when(short, rationale_short()).otherwise(rationale_long()),
        }
    )
    df = df.withColumn("Conviction", conviction()).withColumns(
        {
            "Conviction_Stars": _lookup("Conviction", STARS, STARS["Low"]),
            "conv_rank": _lookup("Conviction", RANK, 1),
            "Suggested_Weight": suggested_weight(),
        }
    )
    return _entry_levels(df).select(*IDEA)


def short_list(snap: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return ideas(snap, cfg).filter(F.col("Type") == SHORT)


def long_list(snap: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return ideas(snap, cfg).filter(F.col("Type") == LONG)


def _best_first():
    return F.col("conv_rank").desc(), F.col("Score").desc(), F.col("instrument")


def ranked(listed: DataFrame) -> DataFrame:
    """Strongest conviction first, then score: a distributed sort.

    A sort looks at its input twice, for the bounds of its ranges and for the rows. The list, a row per idea, is written once, so
    that the indicators behind it are not worked out again.
    """
    return settle(listed).orderBy(*_best_first())


def top_per_list(listed: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each list; Spark keeps only k rows per task before the shuffle."""
    w = Window.partitionBy("Type").orderBy(*_best_first())
    return listed.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).drop("_place")


def allocation(ideas: DataFrame, capital: float) -> DataFrame:
    return ideas.withColumn("Allocation", F.col("Suggested_Weight") * capital)


def exit_alerts(snap: DataFrame, holdings: DataFrame) -> DataFrame:
    """(portfolio_id, instrument, current_value, action, urgency, triggers, suggested_stop, …) for flagged holdings."""
    c, atr = F.col("close"), F.coalesce("ATR_14", F.lit(0.0))
    rsi, r20 = F.coalesce("RSI_14", F.lit(50.0)), F.coalesce("Return_20d", F.lit(0.0))
    sell = (F.col("Signal") == -1) & (F.col("Confidence") > 0.40)
    bear = F.col("Regime_Label") == "BEAR"
    hot = (rsi > 75) & (r20 > 0.15)
    weak = r20 < -0.10
    per_instrument = snap.select(
        "instrument",
        F.when(sell | bear, "EXIT").when(hot | weak, "REDUCE").alias("action"),
        F.when(sell | bear, "HIGH").when(hot | weak, "MEDIUM").alias("urgency"),
        F.concat_ws(
            "; ",
            F.when(sell, F.format_string("SELL signal (conf %.2f)", F.col("Confidence"))),
            F.when(bear, "Regime turned BEAR"),
            F.when(hot, F.format_string("Overbought (RSI %.0f, +%.0f%% in 20d)", rsi, r20 * 100)),
            F.when(weak, F.format_string("20-day return %.1f%%", r20 * 100)),
        ).alias("triggers"),
        F.when(atr > 0, c - 2 * atr).otherwise(c * 0.95).alias("suggested_stop"),
        "close",
        rsi.alias("rsi"),
        F.col("Regime_Label").alias("regime"),
        "as_of",
    ).filter(F.col("action").isNotNull())
    held = holdings.select("portfolio_id", "instrument", F.col("amount").alias("current_value"))
    return held.join(per_instrument, "instrument").select("portfolio_id", *[x for x in per_instrument.columns], "current_value")


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    """HIGH before MEDIUM, then the largest exposure."""
    return alerts.orderBy(
        "portfolio_id", F.when(F.col("urgency") == "HIGH", 0).otherwise(1), F.col("current_value").desc(), "instrument"
    )


def market_summary(signals: DataFrame) -> DataFrame:
    """One row: regime counts on the newest labelled bars, and the market phase."""
    newest = (
        signals.filter(F.col("Regime_Label").isNotNull())
        .groupBy("instrument")
        .agg(F.max_by("Regime_Label", "date").alias("regime"))
    )
    counts = newest.agg(
        *[F.count_if(F.col("regime") == k).alias(k.lower()) for k in ("BULL", "SIDEWAYS", "BEAR")],
        F.count("*").alias("n_scored"),
    )
    n = F.col("n_scored")
    phase = (
        F.when(n == 0, "Unknown")
        .when(F.col("bull") >= 0.5 * n, "Constructive")
        .when(F.col("bear") >= 0.4 * n, "Defensive")
        .otherwise("Mixed / range-bound")
    )
    return counts.withColumn("defensive", F.col("bear") + F.col("sideways")).withColumn("phase", phase)


def day_plan(listed: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: how many ideas, how many of high conviction, how many exits, and the verdict class."""
    rows = listed.select((F.col("Conviction") == "High").cast("int").alias("high"), F.lit(1).alias("buy"), F.lit(0).alias("leave"))
    rows = rows.unionByName(alerts.select(F.lit(0).alias("high"), F.lit(0).alias("buy"), F.lit(1).alias("leave")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    plan = rows.agg(total("buy").alias("n_buys"), total("high").alias("n_high"), total("leave").alias("n_exits"))
    verdict = F.when(F.col("n_buys") == 0, "patience").when(F.col("n_high") > 0, "high-conviction").otherwise("medium-low")
    return plan.withColumn("verdict", verdict)


def weak_record(stats: DataFrame) -> DataFrame:
    """Flag a track record whose losses outweigh its wins."""
    return stats.withColumn("weak", F.coalesce((F.col("n") > 0) & (F.col("profit_factor") < 1.0), F.lit(False)))
