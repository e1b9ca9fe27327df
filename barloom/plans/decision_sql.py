"""SQL re-statements of regimes, signals and ideas."""

from __future__ import annotations

from .common import cte
from .price_sql import PART, full, rows

FEATS = ("Return_5d", "Return_20d", "Volatility_20", "Dist_from_MA200_pct", "RSI_14", "BB_Width")
USABLE = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
NAME = "CASE {} WHEN 0 THEN 'BEAR' WHEN 1 THEN 'SIDEWAYS' WHEN 2 THEN 'BULL' END"

cte(
    "rule0",
    f"""SELECT *, coalesce(w12 < {full('quantile_cont', 'w12', 252, 60).replace('quantile_cont(w12)', 'quantile_cont(w12, 0.2)')}, FALSE) AS squeezed,
CASE WHEN close > MA_200 AND MA_50 > MA_200 THEN 2 WHEN close > MA_200 THEN 1 ELSE 0 END AS trend FROM (SELECT *, round(BB_Width, 12) AS w12 FROM feat)""",
)
cte("reg", f"SELECT *, CASE WHEN squeezed THEN 1 ELSE trend END AS Regime, {NAME.format('CASE WHEN squeezed THEN 1 ELSE trend END')} AS Regime_Label FROM rule0")

# Given clusters: RSI thirds stand in for fitted states, with posteriors that are plain functions of RSI.
cte(
    "given_states",
    f"""SELECT instrument, date, close, Return_5d, CASE WHEN RSI_14 < 45 THEN 2 WHEN RSI_14 < 55 THEN 0 ELSE 1 END AS state,
RSI_14 / 200 AS p0, 0.5 - RSI_14 / 400 AS p1, 0.5 - RSI_14 / 400 AS p2 FROM feat WHERE {USABLE}""",
)
_less = lambda s, u: f"CAST(m{u} < m{s} OR (m{u} = m{s} AND {u} < {s}) AS INT)"
cte(
    "ordered",
    f"""SELECT *, CASE state WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS Regime,
CASE 0 WHEN r0 THEN p0 WHEN r1 THEN p1 ELSE p2 END AS Regime_Prob_Bear, CASE 2 WHEN r0 THEN p0 WHEN r1 THEN p1 ELSE p2 END AS Regime_Prob_Bull
FROM (SELECT *, {_less(0, 1)} + {_less(0, 2)} AS r0, {_less(1, 0)} + {_less(1, 2)} AS r1, {_less(2, 0)} + {_less(2, 1)} AS r2 FROM
 (SELECT *, {', '.join(f"coalesce(avg(CASE WHEN state = {s} THEN Return_5d END) OVER (PARTITION BY instrument), 1e300) AS m{s}" for s in range(3))} FROM given_states))""",
)
cte(
    "smoothed",
    f"""SELECT instrument, date, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS Regime
FROM (SELECT *, {', '.join(f"sum(CAST(Regime = {k} AS INT)) OVER {rows(5)} AS n{k}" for k in range(3))} FROM ordered)""",
)


def signals_ctes(p: str, source: str, prob: str = "NULL::DOUBLE") -> None:
    """Define <p>vote and <p>sig over labelled features."""
    sd = lambda c, n, least: f"nullif({full('stddev_samp', c, n, least)}, 0)"
    cte(
        f"{p}v1",
        f"""SELECT *, {sd('MACD_Hist', 20, 5)} AS hist_sd, coalesce(MACD, 0) - lag(coalesce(MACD, 0), 3) OVER ({PART}) AS macd_slope,
OBV - lag(OBV, 10) OVER ({PART}) AS slope, {prob} AS pb FROM {source}""",
    )
    cte(
        f"{p}vote",
        f"""SELECT *, (2 * MA20_above_MA50 - 1 + 2 * MA50_above_MA200 - 1 + coalesce(tanh(MACD_Hist / hist_sd), 0) + 2 * Close_above_MA200 - 1) / 4 AS Score_Trend,
(CASE WHEN coalesce(RSI_14, 50) < 30 THEN -1 WHEN coalesce(RSI_14, 50) <= 70 THEN (coalesce(RSI_14, 50) - 50) / 20 ELSE 1 - (RSI_14 - 70) / 30 END
 + tanh(sign(coalesce(MACD, 0)) * 0.5::DOUBLE + coalesce(macd_slope, 0) * 2) + tanh(coalesce(ROC_10, 0) / 5)) / 3 AS Score_Momentum,
((1 - 2 * coalesce(least(greatest(BB_Pct, CASE WHEN BB_Pct IS NOT NULL THEN 0 END), 1 + 0 * BB_Pct), 0.5::DOUBLE)) + (1 - 2 * ((coalesce(Stoch_K, 50) + coalesce(Stoch_D, 50)) / 200))) / 2 AS Score_MeanRev,
sign(coalesce(Return_5d, 0)) * (0.5::DOUBLE * coalesce(tanh(slope / slope_sd), 0) + 0.5::DOUBLE * tanh(least(coalesce(Vol_Ratio, 1), 5) - 1)) AS Score_Volume
FROM (SELECT *, {sd('slope', 60, 10)} AS slope_sd FROM {p}v1)""",
    )
    cte(
        f"{p}gated",
        f"""SELECT *, CASE WHEN pb IS NULL THEN bg ELSE greatest(0.1, bg - 0.2::DOUBLE * (pb - 0.5)) END AS buy,
CASE WHEN pb IS NULL THEN sg ELSE greatest(0.1, sg + 0.2::DOUBLE * (pb - 0.5)) END AS sell
FROM (SELECT *, 0.3::DOUBLE * Score_Trend + 0.3::DOUBLE * Score_Momentum + 0.2::DOUBLE * Score_MeanRev + 0.2::DOUBLE * Score_Volume AS Score_Raw,
 CASE Regime_Label WHEN 'BULL' THEN 0.3 WHEN 'BEAR' THEN 0.5 ELSE 0.4 END::DOUBLE AS bg, CASE Regime_Label WHEN 'BULL' THEN 0.5 WHEN 'BEAR' THEN 0.25 ELSE 0.4 END::DOUBLE AS sg,
 CASE Regime_Label WHEN 'BULL' THEN 1.0 WHEN 'BEAR' THEN 0.5 ELSE 0.7 END::DOUBLE AS sm FROM {p}vote)""",
    )
    cte(
        f"{p}sig",
        f"""SELECT *, CASE WHEN Signal <> 0 THEN sm ELSE 0.0 END AS Size_Mult,
CASE Signal WHEN 0 THEN 'Hold' WHEN 1 THEN CASE WHEN Confidence >= 0.75 THEN 'Strong Buy' ELSE 'Buy' END ELSE CASE WHEN Confidence >= 0.75 THEN 'Strong Sell' ELSE 'Sell' END END AS Signal_Strength,
close AS Entry_Price, close - 2 * ATR_14 * Signal AS Stop_Loss, close + 2 * ATR_14 * Signal AS Target_1, close + 4 * ATR_14 * Signal AS Target_2,
coalesce(abs(4 * ATR_14 * Signal) / nullif(abs(2 * ATR_14 * Signal), 0), 0) AS Risk_Reward
FROM (SELECT *, CASE WHEN Score_Raw >= buy THEN 1 WHEN Score_Raw <= -sell THEN -1 ELSE 0 END AS Signal, least(1.0, abs(Score_Raw)) AS Confidence FROM {p}gated)""",
    )


signals_ctes("", "reg")
signals_ctes("t_", "reg", "BB_Pct")
