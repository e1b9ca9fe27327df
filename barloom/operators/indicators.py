"""The technical-indicator frame: one shuffle on the key, everything else local windows."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, change, ratio, rolled, running, series
from ..functions.recurrence import linear
from ..settings import DEFAULTS, Settings

COLUMNS = [
    "MA_20", "MA_50", "MA_200", "EMA_12", "EMA_26", "MACD", "MACD_Signal", "MACD_Hist", "MA20_above_MA50",
    "MA50_above_MA200", "RSI_14", "ROC_10", "Stoch_K", "Stoch_D", "BB_Upper", "BB_Mid", "BB_Lower", "BB_Width",
    "BB_Pct", "ATR_14", "Volatility_20", "OBV", "Vol_MA_20", "Vol_Ratio", "Return_5d", "Return_20d", "High_Low_Pct",
    "Gap_Pct", "Close_above_MA200", "Dist_from_MA200_pct",
]


def _flag(cond):
    return F.coalesce(cond.cast("int"), F.lit(0))


def indicators(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    """Bars (with returns) plus the 30 indicator columns."""
    w = series(keys)
    c, h, lo, v = (F.col(n) for n in ("close", "high", "low", "volume"))
    given = bars.columns
    if "Adj_Return" not in given:
        bars = bars.withColumn("Adj_Return", F.log1p(change(c, 1, keys)))

    # Pass 1: frames over raw columns.
    df = bars.select(
        "*",
        (F.row_number().over(w) - 1).alias("seq"),
        F.lag(c, 1).over(w).alias("_prev"),
        F.lag(c, 5).over(w).alias("_c5"),
        F.lag(c, cfg.roc).over(w).alias("_croc"),
        F.lag(c, 20).over(w).alias("_c20"),
        rolled(F.avg, c, cfg.ma_short, keys).alias("MA_20"),
        rolled(F.avg, c, cfg.ma_medium, keys).alias("MA_50"),
        rolled(F.avg, c, cfg.ma_long, keys).alias("MA_200"),
        rolled(F.min, lo, cfg.stoch_k, keys).alias("_low_k"),
        rolled(F.max, h, cfg.stoch_k, keys).alias("_high_k"),
        rolled(F.avg, c, cfg.band, keys).alias("BB_Mid"),
        rolled(F.stddev_pop, c, cfg.band, keys).alias("_band_sd"),
        rolled(F.avg, v, cfg.volume_ma, keys).alias("Vol_MA_20"),
        (rolled(F.stddev_samp, F.col("Adj_Return"), cfg.vol, keys) * sqrt(cfg.trading_days)).alias("Volatility_20"),
    )

    # Pass 2: frames over values that needed the previous close.
    step = F.coalesce(c - F.col("_prev"), F.lit(0.0))
    half = cfg.band_sigmas * F.col("_band_sd")
    df = df.withColumns(
        {
            "_tr": F.greatest(h - lo, F.abs(h - F.col("_prev")), F.abs(lo - F.col("_prev"))),
            "_gain": F.greatest(step, F.lit(0.0)),
            "_loss": F.greatest(-step, F.lit(0.0)),
            "Stoch_K": 100 * ratio(c - F.col("_low_k"), F.col("_high_k") - F.col("_low_k")),
            "BB_Upper": F.col("BB_Mid") + half,
            "BB_Lower": F.col("BB_Mid") - half,
        }
    )
    df = df.select(
        "*",
        rolled(F.avg, F.col("Stoch_K"), cfg.stoch_d, keys).alias("Stoch_D"),
        F.avg("_tr").over(w.rowsBetween(-(cfg.atr - 1), 0)).alias("_tr_mean"),
        F.sum(F.when(c < F.col("_prev"), -v).otherwise(v)).over(running(keys)).alias("OBV"),
    )

    # Pass 3: recursive smoothers.
    first = F.col("seq") == 0
    fast, slow = 2.0 / (cfg.ema_fast + 1), 2.0 / (cfg.ema_slow + 1)
    wilder = 1.0 / cfg.rsi
    seed = cfg.atr - 1
    df = df.withColumns(
        {
            "_b_fast": F.when(first, c).otherwise(c * fast),
            "_b_slow": F.when(first, c).otherwise(c * slow),
            "_b_gain": F.when(first, 0.0).otherwise(F.col("_gain") * wilder),
            "_b_loss": F.when(first, 0.0).otherwise(F.col("_loss") * wilder),
            "_b_atr": F.when(F.col("seq") < seed, 0.0)
            .when(F.col("seq") == seed, F.col("_tr_mean"))
            .otherwise(F.col("_tr") / cfg.atr),
        }
    )
    df = linear(
        df,
        {
            "_fast": ("_b_fast", 1 - fast),
            "_slow": ("_b_slow", 1 - slow),
            "_up": ("_b_gain", 1 - wilder),
            "_down": ("_b_loss", 1 - wilder),
            "ATR_14": ("_b_atr", 1 - 1.0 / cfg.atr),
        },
        keys,
        keep_blocks=True,
    )
    start = cfg.ema_slow - 1
    alpha = 2.0 / (cfg.macd_signal + 1)
    df = df.withColumn("MACD", F.when(F.col("seq") >= start, F.col("_fast") - F.col("_slow")))
    df = df.withColumn(
        "_b_signal",
        F.when(F.col("seq") < start, 0.0).when(F.col("seq") == start, F.col("MACD")).otherwise(F.col("MACD") * alpha),
    )
    df = linear(df, {"_signal": ("_b_signal", 1 - alpha)}, keys)

    # Row-wise arithmetic.
    df = df.withColumns(
        {
            "EMA_12": F.when(F.col("seq") >= cfg.ema_fast - 1, F.col("_fast")),
            "EMA_26": F.when(F.col("seq") >= start, F.col("_slow")),
            "MACD_Signal": F.when(F.col("seq") >= start + cfg.macd_signal - 1, F.col("_signal")),
            "MA20_above_MA50": _flag(F.col("MA_20") > F.col("MA_50")),
            "MA50_above_MA200": _flag(F.col("MA_50") > F.col("MA_200")),
            "RSI_14": F.when(
                F.col("seq") >= cfg.rsi - 1,
                F.when(F.col("_down") == 0, 100.0).otherwise(
                    100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0)))
                ),
            ),
            "ROC_10": 100 * ratio(c - F.col("_croc"), F.col("_croc")),
            "BB_Width": ratio(F.col("BB_Upper") - F.col("BB_Lower"), F.col("BB_Mid")),
            "BB_Pct": ratio(c - F.col("BB_Lower"), F.col("BB_Upper") - F.col("BB_Lower")),
            "Vol_Ratio": ratio(v, F.col("Vol_MA_20")),
            "Return_5d": ratio(c, F.col("_c5")) - 1,
            "Return_20d": ratio(c, F.col("_c20")) - 1,
            "High_Low_Pct": ratio(h - lo, c),
            "Gap_Pct": ratio(F.col("open") - F.col("_prev"), F.col("_prev")),
            "Close_above_MA200": _flag(c > F.col("MA_200")),
            "Dist_from_MA200_pct": ratio(c - F.col("MA_200"), F.col("MA_200")),
        }
    ).withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))
    kept = list(given) + ([] if "Adj_Return" in given else ["Adj_Return"])
    return df.select(*kept, *COLUMNS)
