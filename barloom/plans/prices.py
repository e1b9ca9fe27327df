"""Registered queries: indicators and returns."""

from __future__ import annotations

from ..operators import indicators as ind
from ..operators.returns import prepare
from ..sources import panels
from . import price_sql  # noqa: F401
from .common import big, pick_sql, rnd, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEY = ("instrument", "date")


def features(spark, sf):
    return ind.indicators(prepare(panels.daily_bars(spark, sf)))


def _columns(name: str, flags=(), **digits) -> None:
    """Register a query that shows some feature columns for every bar."""

    def run(spark, sf):
        return features(spark, sf).select(*KEY, *[big(c) for c in flags], *[rnd(c, n) for c, n in digits.items()])

    QUERIES[name] = run
    ints = [f"CAST({c} AS BIGINT) AS {c}" for c in flags]
    ORACLES[name] = sql(f"SELECT {pick_sql((*KEY, *ints), **digits)} FROM feat")


_columns("RET1_daily_return", Daily_Return=8)
_columns("RET2_log_return", Adj_Return=8)
_columns("RET3_period_returns", Return_5d=8, Return_20d=8)
_columns("IND1_moving_averages", MA_20=8, MA_50=8, MA_200=8)
_columns("IND2_exponential_averages", EMA_12=5, EMA_26=5)
_columns("IND3_macd", MACD=6, MACD_Signal=6, MACD_Hist=6)
_columns("IND4_crossover_flags", flags=("MA20_above_MA50", "MA50_above_MA200"))
_columns("IND5_rsi", RSI_14=5)
_columns("IND6_rate_of_change", ROC_10=6)
_columns("IND7_stochastic", Stoch_K=5, Stoch_D=5)
_columns("IND8_bands", BB_Upper=5, BB_Mid=8, BB_Lower=5)
_columns("IND9_band_width", BB_Width=6)
_columns("IND10_band_position", BB_Pct=6)
_columns("IND11_average_true_range", ATR_14=5)
_columns("IND12_volatility", Volatility_20=6)
_columns("IND13_on_balance_volume", OBV=3)
_columns("IND14_volume_ratio", Vol_MA_20=4, Vol_Ratio=6)
_columns("IND15_high_low_pct", High_Low_Pct=7)
_columns("IND16_gap_pct", Gap_Pct=8)
_columns("IND17_long_average_filter", flags=("Close_above_MA200",), Dist_from_MA200_pct=6)

DIGITS = {**dict.fromkeys(ind.COLUMNS, 5), "MA_20": 8, "MA_50": 8, "MA_200": 8, "BB_Mid": 8}
FLAGS = ("MA20_above_MA50", "MA50_above_MA200", "Close_above_MA200")
for _f in FLAGS:
    DIGITS.pop(_f)
_columns("IND18_all_indicators", flags=FLAGS, **DIGITS)
