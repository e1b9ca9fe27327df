"""SQL re-statements of the panels and of the price pipeline up to signals."""

from __future__ import annotations

from math import sqrt

from ..operators.indicators import COLUMNS
from .common import cte

PART = "PARTITION BY instrument ORDER BY date"


def rows(n: int) -> str:
    return f"({PART} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, col: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {rows(n)} >= {least or n} THEN {agg}({col}) OVER {rows(n)} END"


def bars_sql(source: str, scale: float) -> str:
    return f"""
SELECT instrument, date, open, greatest(open, close) * (1 + 0.1 * top_discount) AS high,
       least(open, close) * (1 - 0.1 * top_tax) AS low, close, volume
FROM (SELECT *, coalesce(lag(close) OVER ({PART}) * (1 + 0.1 * (tax - 0.04)), close) AS open
      FROM (SELECT *, round(100 * exp(sum(lr) OVER ({PART} ROWS UNBOUNDED PRECEDING)), 4) AS close
            FROM (SELECT instrument, date,
                         {scale} * (sum(CAST(round(l_discount * 100) AS BIGINT)) / (100 * count(*)) - 0.05::DOUBLE) AS lr,
                         sum(CAST(round(l_tax * 100) AS BIGINT)) / (100 * count(*)) AS tax,
                         max(l_discount) AS top_discount, max(l_tax) AS top_tax, sum(l_quantity) AS volume
                  FROM ({source}) GROUP BY instrument, date)))"""


LINE = "l_discount, l_tax, l_quantity"
cte("bars", bars_sql(f"SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS date, {LINE} FROM lineitem", 0.3))
cte(
    "wbars",
    bars_sql(
        f"SELECT p_brand AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {LINE} "
        "FROM lineitem JOIN part ON l_partkey = p_partkey",
        0.8,
    ),
)
cte("bench", bars_sql(f"SELECT 'MARKET' AS instrument, CAST(l_shipdate AS DATE) AS date, {LINE} FROM lineitem", 0.3))
cte(
    "wbench",
    bars_sql(f"SELECT 'MARKET' AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {LINE} FROM lineitem", 0.8),
)
cte(
    "defective",
    f"""
SELECT instrument, date, {', '.join(f'CASE WHEN gap THEN NULL WHEN bad THEN 0.0 WHEN jump THEN {c} * 2 ELSE {c} END AS {c}' for c in ('open', 'high', 'low', 'close'))},
       CASE WHEN gap AND n % 2 = 0 THEN NULL ELSE volume END AS volume
FROM (SELECT *, (n + k) % 40 < k % 8 AS gap, k % 9 = 4 AND n = 30 AS bad, k % 7 = 2 AND n % 150 = 75 AS jump
      FROM (SELECT *, row_number() OVER ({PART}) AS n, CAST(instrument AS BIGINT) AS k FROM bars))
WHERE NOT (k % 10 = 3 AND n > 90)""",
)
cte(
    "sectors",
    "SELECT CAST(s_suppkey AS VARCHAR) AS instrument, r_name AS sector FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
cte(
    "holdings",
    """
SELECT CAST(o_custkey // 25 AS VARCHAR) AS portfolio_id, p_brand AS instrument,
       round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""",
)


def returns_sql(source: str) -> str:
    return f"SELECT *, CASE WHEN Daily_Return > -1 THEN ln(1 + Daily_Return) END AS Adj_Return FROM (SELECT *, close / nullif(lag(close) OVER ({PART}), 0) - 1 AS Daily_Return FROM {source})"


def smooth(b: str, q: str, seq: str = "seq") -> str:
    """Closed form of y = q*y' + b over a whole series."""
    return f"pow({q}, {seq}) * sum({b} * pow({q}, -{seq})) OVER ({PART} ROWS UNBOUNDED PRECEDING)"


def features_ctes(prefix: str, source: str) -> None:
    """Define <prefix>ret, <prefix>f1..f4 and <prefix>feat over bars in `source`."""
    p = prefix
    cte(f"{p}ret", returns_sql(source))
    cte(
        f"{p}f1",
        f"""SELECT *, row_number() OVER ({PART}) - 1 AS seq, lag(close) OVER ({PART}) AS prev,
lag(close, 5) OVER ({PART}) AS c5, lag(close, 10) OVER ({PART}) AS c10, lag(close, 20) OVER ({PART}) AS c20,
{full('avg', 'close', 20)} AS MA_20, {full('avg', 'close', 50)} AS MA_50, {full('avg', 'close', 200)} AS MA_200,
{full('min', 'low', 14)} AS lo14, {full('max', 'high', 14)} AS hi14,
{full('stddev_pop', 'close', 20)} AS sd20, {full('avg', 'volume', 20)} AS Vol_MA_20,
({full('stddev_samp', 'Adj_Return', 20)}) * {sqrt(252)!r} AS Volatility_20 FROM {p}ret""",
    )
    cte(
        f"{p}f2",
        f"""SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
greatest(coalesce(close - prev, 0), 0) AS gain, greatest(coalesce(prev - close, 0), 0) AS loss,
100 * (close - lo14) / nullif(hi14 - lo14, 0) AS Stoch_K, MA_20 + 2.0::DOUBLE * sd20 AS BB_Upper, MA_20 AS BB_Mid,
MA_20 - 2.0::DOUBLE * sd20 AS BB_Lower,
sum(CASE WHEN close < prev THEN -volume ELSE volume END) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS OBV FROM {p}f1""",
    )
    ema = lambda n: smooth(f"(CASE WHEN seq = 0 THEN close ELSE close * 2.0::DOUBLE / {n + 1} END)", f"(1 - 2.0::DOUBLE / {n + 1})")
    wilder = lambda c: smooth(f"(CASE WHEN seq = 0 THEN 0 ELSE {c} / 14.0::DOUBLE END)", "(1 - 1.0::DOUBLE / 14)")
    cte(
        f"{p}f3",
        f"""SELECT *, {full('avg', 'Stoch_K', 3)} AS Stoch_D, {ema(12)} AS e12, {ema(26)} AS e26, {wilder('gain')} AS up, {wilder('loss')} AS dn,
{smooth("(CASE WHEN seq < 13 THEN 0 WHEN seq = 13 THEN tr_mean ELSE tr / 14.0::DOUBLE END)", "(1 - 1.0::DOUBLE / 14)")} AS ATR_14
FROM (SELECT *, avg(tr) OVER {rows(14)} AS tr_mean FROM {p}f2)""",
    )
    cte(
        f"{p}f4",
        f"""SELECT *, {smooth('(CASE WHEN seq < 25 THEN 0 WHEN seq = 25 THEN MACD ELSE MACD * 0.2::DOUBLE END)', '(1 - 0.2::DOUBLE)')} AS sg
FROM (SELECT *, CASE WHEN seq >= 25 THEN e12 - e26 END AS MACD FROM {p}f3)""",
    )
    cols = {
        "EMA_12": "CASE WHEN seq >= 11 THEN e12 END",
        "EMA_26": "CASE WHEN seq >= 25 THEN e26 END",
        "MACD_Signal": "CASE WHEN seq >= 33 THEN sg END",
        "MACD_Hist": "CASE WHEN seq >= 33 THEN MACD - sg END",
        "MA20_above_MA50": "coalesce(CAST(MA_20 > MA_50 AS INT), 0)",
        "MA50_above_MA200": "coalesce(CAST(MA_50 > MA_200 AS INT), 0)",
        "RSI_14": "CASE WHEN seq >= 13 THEN CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END END",
        "ROC_10": "100 * ((close - c10) / c10)",
        "BB_Width": "(BB_Upper - BB_Lower) / BB_Mid",
        "BB_Pct": "(close - BB_Lower) / nullif(BB_Upper - BB_Lower, 0)",
        "Vol_Ratio": "volume / nullif(Vol_MA_20, 0)",
        "Return_5d": "close / c5 - 1",
        "Return_20d": "close / c20 - 1",
        "High_Low_Pct": "(high - low) / nullif(close, 0)",
        "Gap_Pct": "(open - prev) / nullif(prev, 0)",
        "Close_above_MA200": "coalesce(CAST(close > MA_200 AS INT), 0)",
        "Dist_from_MA200_pct": "(close - MA_200) / nullif(MA_200, 0)",
    }
    chosen = ", ".join(f"{cols[c]} AS {c}" if c in cols else c for c in COLUMNS)
    cte(f"{p}feat", f"SELECT instrument, date, open, high, low, close, volume, Daily_Return, Adj_Return, {chosen} FROM {p}f4")


features_ctes("", "bars")
features_ctes("b_", "bench")

# Quality-filled defective bars through the same pipeline.
cte(
    "patched",
    "SELECT * FROM (SELECT instrument, date, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER {rows(3)} AS {c}" for c in ("open", "high", "low", "close"))
    + ", volume FROM defective) WHERE close IS NOT NULL",
)
features_ctes("d_", "patched")
