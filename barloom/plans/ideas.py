"""Registered queries: ranked ideas, exit alerts and trade outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..operators import ideas as idea
from ..operators import outcomes as out
from ..sources import panels
from . import decision_sql  # noqa: F401
from .common import big, cte, r, rnd, sql
from .decisions import signalled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


def snapshot(spark, sf):
    return idea.snapshot(signalled(spark, sf))


def stock_holdings(spark, sf):
    """Money per order priority (portfolio) and supplier (instrument)."""
    lines = panels.table(spark, sf, "lineitem")
    orders = panels.table(spark, sf, "orders")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_orderpriority").alias("portfolio_id"), F.col("l_suppkey").cast("string").alias("instrument")
        )
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    )


cte(
    "stock_holdings",
    "SELECT o_orderpriority AS portfolio_id, CAST(l_suppkey AS VARCHAR) AS instrument, round(sum(l_extendedprice), 2) AS amount "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
_rsi = "CASE WHEN RSI_14 BETWEEN 30 AND 55 THEN (RSI_14 - 30) / 25 WHEN RSI_14 > 55 AND RSI_14 <= 80 THEN (80 - RSI_14) / 25 ELSE 0 END"
_quality = (
    "CASE WHEN Dist_from_MA200_pct IS NULL OR Dist_from_MA200_pct < 0 THEN 0 WHEN Dist_from_MA200_pct < 0.05 THEN Dist_from_MA200_pct / 0.05::DOUBLE "
    "WHEN Dist_from_MA200_pct <= 0.2 THEN 1 WHEN Dist_from_MA200_pct <= 0.4 THEN (0.4::DOUBLE - Dist_from_MA200_pct) / 0.2::DOUBLE ELSE 0 END"
)
_agree = "CAST(Score_Trend > 0.05 AS INT) + CAST(Score_Momentum > 0.05 AS INT) + CAST(Score_Volume > 0.05 AS INT)"
cte(
    "scored",
    f"""SELECT *, coalesce(Signal >= 0 AND Confidence >= 0.3 AND Return_20d > 0 AND Regime_Label IN ('SIDEWAYS', 'BULL') AND short_score >= 0.28 AND agree >= 2, FALSE) AS short_ok,
coalesce(Close_above_MA200 = 1 AND Signal >= 0 AND Regime_Label = 'BULL' AND Volatility_20 < 0.45, FALSE) AS long_ok
FROM (SELECT *, 0.3::DOUBLE * greatest(tanh(Return_20d / 0.2::DOUBLE), 0) + 0.25::DOUBLE * least(greatest(Confidence, 0), 1) + 0.2::DOUBLE * ({_rsi})
 + 0.15::DOUBLE * greatest(tanh(coalesce(Vol_Ratio, 1) - 1), 0) + 0.1::DOUBLE * CASE Regime_Label WHEN 'BULL' THEN 1.0 WHEN 'SIDEWAYS' THEN 0.5 ELSE 0.0 END::DOUBLE AS short_score,
 0.25::DOUBLE * Close_above_MA200 + 0.25::DOUBLE * least(greatest(1 - Volatility_20 / 0.45::DOUBLE, 0), 1) + 0.2::DOUBLE * ({_quality}) + 0.15::DOUBLE * least(greatest(Confidence, 0), 1)
 + 0.15::DOUBLE * least(greatest(Return_20d, 0) / 0.15::DOUBLE, 1) AS long_score, {_agree} AS agree FROM sig)""",
)
cte(
    "snap",
    "SELECT * FROM scored WHERE close IS NOT NULL AND RSI_14 IS NOT NULL AND MA_200 IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY date DESC) = 1",
)


def _list_sql(kind: str) -> str:
    if kind == "short":
        where, score, type_ = "short_ok", "short_score", "Short-Term"
        period = "CASE WHEN Volatility_20 IS NULL OR Volatility_20 < 0.2 THEN '6–8 weeks' WHEN Volatility_20 < 0.35 THEN '4–6 weeks' ELSE '2–4 weeks' END"
        why = (
            "concat_ws('; ', printf('20-day return %+.1f%%', Return_20d * 100), CASE WHEN RSI_14 BETWEEN 50 AND 65 THEN printf('RSI %.0f (healthy momentum)', RSI_14) "
            "WHEN RSI_14 > 65 THEN printf('RSI %.0f (strong, watch overbought)', RSI_14) END, CASE WHEN Vol_Ratio > 1.5 THEN printf('volume %.1f× avg confirms', Vol_Ratio) END, "
            "CASE WHEN Regime_Label = 'BULL' THEN 'bullish regime tailwind' END) || '.'"
        )
    else:
        where, score, type_ = "long_ok AND NOT short_ok", "long_score", "Long-Term"
        period = "CASE WHEN Volatility_20 IS NULL OR Volatility_20 < 0.2 THEN '12–18 months' WHEN Volatility_20 < 0.3 THEN '6–12 months' ELSE '3–6 months' END"
        why = (
            "concat_ws('; ', printf('%+.1f%% above MA200', Dist_from_MA200_pct * 100), CASE WHEN Volatility_20 < 0.2 THEN printf('low annualised vol (%.0f%%)', Volatility_20 * 100) "
            "WHEN Volatility_20 < 0.3 THEN printf('moderate vol (%.0f%%)', Volatility_20 * 100) END, 'bullish regime') || '.'"
        )
    return f"""SELECT *, CASE conv_rank WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS Conviction,
CASE conv_rank WHEN 3 THEN '★★★' WHEN 2 THEN '★★☆' ELSE '★☆☆' END AS Conviction_Stars,
CASE conv_rank WHEN 3 THEN 0.1 WHEN 2 THEN 0.06 ELSE 0.03 END::DOUBLE * CASE Regime_Label WHEN 'BULL' THEN 1.0 WHEN 'BEAR' THEN 0.5 ELSE 0.7 END::DOUBLE AS Suggested_Weight,
close * 0.995::DOUBLE AS Entry_Low, close * 1.005::DOUBLE AS Entry_High, close - 2 * ATR_14 AS Stop, close + 2 * ATR_14 AS T1, close + 4 * ATR_14 AS T2,
{period} AS Holding_Period, {why} AS Rationale
FROM (SELECT *, '{type_}' AS Type, {score} AS Score, CASE WHEN {score} >= 0.45 AND agree >= 3 AND Confidence >= 0.38 THEN 3 WHEN {score} >= 0.32 AND agree >= 2 THEN 2 ELSE 1 END AS conv_rank
 FROM snap WHERE {where})"""


cte("short_ideas", _list_sql("short"))
cte("long_ideas", _list_sql("long"))


@register(
    "REC1_latest_snapshot",
    f"SELECT instrument, date AS as_of, {r('close', 5)}, {r('RSI_14', 5)}, {r('MA_200', 8)}, CAST(Signal AS BIGINT) AS Signal, {r('Confidence', 6)}, Regime_Label FROM snap",
)
def _(spark, sf):
    return snapshot(spark, sf).select(
        "instrument", "as_of", rnd("close", 5), rnd("RSI_14", 5), rnd("MA_200", 8), big("Signal"), rnd("Confidence", 6), "Regime_Label"
    )


def _per_bar(name: str, expr, column: str, digits: int, oracle: str) -> None:
    @register(name, f"SELECT instrument, date, {r(oracle, digits, column)} FROM scored")
    def _(spark, sf):
        return signalled(spark, sf).select("instrument", "date", rnd(expr(), digits, column))


_per_bar("REC2_rsi_score", lambda: idea.rsi_score(F.col("RSI_14")), "rsi_score", 6, _rsi)
_per_bar("REC3_trend_quality", lambda: idea.trend_quality(F.col("Dist_from_MA200_pct")), "trend_quality", 6, _quality)
_per_bar("REC4_short_score", idea.short_score, "short_score", 6, "short_score")


@register("REC5_engine_agreement", "SELECT instrument, date, CAST(agree AS BIGINT) AS agreement FROM scored")
def _(spark, sf):
    return signalled(spark, sf).select("instrument", "date", big(idea.agreement(), "agreement"))


@register("REC6_short_eligibility", "SELECT instrument, date, short_ok AS eligible FROM scored")
def _(spark, sf):
    return signalled(spark, sf).select("instrument", "date", idea.short_eligible().alias("eligible"))


def _ideas_query(name: str, build, source: str) -> None:
    shown = {
        "Score": 6,
        "Suggested_Weight": 4,
        "Confidence": 6,
        "close": 5,
        "Entry_Low": 5,
        "Entry_High": 5,
        "RSI_14": 5,
        "Volatility_20": 6,
    }
    text = ("instrument", "Type", "Conviction", "Conviction_Stars", "Signal_Strength", "Holding_Period", "Regime_Label", "Rationale")
    levels = {"Stop": "Stop_Loss", "T1": "Target_1", "T2": "Target_2"}

    @register(
        name,
        f"SELECT {', '.join(text)}, date AS as_of, CAST(conv_rank AS BIGINT) AS conv_rank, CAST(agree AS BIGINT) AS Engine_Agreement, "
        + ", ".join(r(c, n) for c, n in shown.items())
        + ", "
        + ", ".join(r(c, 5, to) for c, to in levels.items())
        + f", {r('abs(T2 - close) / nullif(abs(close - Stop), 0)', 5, 'Risk_Reward')} FROM {source}",
    )
    def _(spark, sf):
        df = build(snapshot(spark, sf))
        return df.select(
            *text,
            "as_of",
            big("conv_rank"),
            big("Engine_Agreement"),
            *[rnd(c, n) for c, n in shown.items()],
            *[rnd(c, 5) for c in ("Stop_Loss", "Target_1", "Target_2", "Risk_Reward")],
        )


_ideas_query("REC7_short_ranking", lambda s: idea.ranked(idea.short_list(s)), "short_ideas")
_ideas_query("REC8_long_ranking", lambda s: idea.ranked(idea.long_list(s)), "long_ideas")


@register(
    "REC9_conviction",
    "SELECT instrument, Type, Conviction, Conviction_Stars FROM short_ideas UNION ALL SELECT instrument, Type, Conviction, Conviction_Stars FROM long_ideas",
)
def _(spark, sf):
    return idea.ideas(snapshot(spark, sf)).select("instrument", "Type", "Conviction", "Conviction_Stars")


def _both(name, columns, oracle_columns):
    @register(name, f"SELECT instrument, Type, {oracle_columns} FROM (FROM short_ideas UNION ALL FROM long_ideas)")
    def _(spark, sf):
        return idea.ideas(snapshot(spark, sf)).select("instrument", "Type", *columns())


_both("REC10_suggested_weight", lambda: [rnd("Suggested_Weight", 4)], r("Suggested_Weight", 4))
_both("REC11_holding_period", lambda: ["Holding_Period"], "Holding_Period")
_both("REC12_rationale", lambda: ["Rationale"], "Rationale")
_both(
    "REC13_entry_band",
    lambda: [rnd(c, 5) for c in ("Entry_Low", "Entry_High", "Stop_Loss", "Target_1", "Target_2")],
    f"{r('Entry_Low', 5)}, {r('Entry_High', 5)}, {r('Stop', 5, 'Stop_Loss')}, {r('T1', 5, 'Target_1')}, {r('T2', 5, 'Target_2')}",
)
_TOP = "SELECT * FROM {} ORDER BY conv_rank DESC, Score DESC, instrument LIMIT 10"


@register(
    "REC14_top_lists",
    f"SELECT instrument, Type, Conviction, {r('Score', 6)} FROM ((FROM ({_TOP.format('short_ideas')})) UNION ALL (FROM ({_TOP.format('long_ideas')})))",
)
def _(spark, sf):
    top = idea.top_per_list(idea.ideas(snapshot(spark, sf)))
    return top.select("instrument", "Type", "Conviction", rnd("Score", 6))


cte(
    "alerts",
    """SELECT portfolio_id, h.instrument, amount AS current_value, CASE WHEN is_sell OR bear THEN 'EXIT' ELSE 'REDUCE' END AS action,
CASE WHEN is_sell OR bear THEN 'HIGH' ELSE 'MEDIUM' END AS urgency,
concat_ws('; ', CASE WHEN is_sell THEN printf('SELL signal (conf %.2f)', Confidence) END, CASE WHEN bear THEN 'Regime turned BEAR' END,
 CASE WHEN hot THEN printf('Overbought (RSI %.0f, +%.0f%% in 20d)', RSI_14, Return_20d * 100) END, CASE WHEN weak THEN printf('20-day return %.1f%%', Return_20d * 100) END) AS triggers,
CASE WHEN ATR_14 > 0 THEN close - 2 * ATR_14 ELSE close * 0.95::DOUBLE END AS suggested_stop, close, RSI_14 AS rsi, Regime_Label AS regime, date AS as_of
FROM stock_holdings h JOIN (SELECT *, Signal = -1 AND Confidence > 0.4 AS is_sell, Regime_Label = 'BEAR' AS bear, RSI_14 > 75 AND Return_20d > 0.15 AS hot, Return_20d < -0.1 AS weak FROM snap) s
ON h.instrument = s.instrument WHERE is_sell OR bear OR hot OR weak""",
)


@register(
    "REC15_exit_alerts",
    f"SELECT portfolio_id, instrument, {r('current_value', 2)}, action, urgency, triggers, {r('suggested_stop', 5)}, {r('close', 5)}, {r('rsi', 5)}, regime, as_of FROM alerts",
)
def _(spark, sf):
    df = idea.ordered_alerts(idea.exit_alerts(snapshot(spark, sf), stock_holdings(spark, sf)))
    return df.select(
        "portfolio_id",
        "instrument",
        rnd("current_value", 2),
        "action",
        "urgency",
        "triggers",
        *[rnd(c, 5) for c in ("suggested_stop", "close", "rsi")],
        "regime",
        "as_of",
    )


@register(
    "REC16_market_summary",
    """SELECT bull, sideways, bear, n_scored, bear + sideways AS defensive, CASE WHEN n_scored = 0 THEN 'Unknown' WHEN bull >= 0.5 * n_scored THEN 'Constructive'
WHEN bear >= 0.4 * n_scored THEN 'Defensive' ELSE 'Mixed / range-bound' END AS phase FROM (SELECT count(*) FILTER (Regime_Label = 'BULL') AS bull, count(*) FILTER (Regime_Label = 'SIDEWAYS') AS sideways,
count(*) FILTER (Regime_Label = 'BEAR') AS bear, count(*) AS n_scored FROM newest_sig)""",
)
def _(spark, sf):
    return idea.market_summary(signalled(spark, sf))


@register("REC17_allocation", f"SELECT instrument, {r('Suggested_Weight * 100000', 2, 'Allocation')} FROM short_ideas")
def _(spark, sf):
    ideas = idea.allocation(idea.short_list(snapshot(spark, sf)), 100_000.0)
    return ideas.select("instrument", rnd("Allocation", 2))


@register(
    "REC18_day_plan",
    f"""SELECT n_buys, n_high, n_exits, CASE WHEN n_buys = 0 THEN 'patience' WHEN n_high > 0 THEN 'high-conviction' ELSE 'medium-low' END AS verdict
FROM (SELECT (SELECT count(*) FROM ({_TOP.format('short_ideas')})) + (SELECT count(*) FROM ({_TOP.format('long_ideas')})) AS n_buys,
(SELECT count(*) FROM ({_TOP.format('short_ideas')}) WHERE conv_rank = 3) + (SELECT count(*) FROM ({_TOP.format('long_ideas')}) WHERE conv_rank = 3) AS n_high, (SELECT count(*) FROM alerts) AS n_exits)""",
)
def _(spark, sf):
    snap = settle(snapshot(spark, sf))
    return idea.day_plan(idea.top_per_list(idea.ideas(snap)), idea.exit_alerts(snap, stock_holdings(spark, sf)))


# ---- track record ----

cte(
    "complete",
    """SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS i FROM (
 SELECT *, count(*) OVER (PARTITION BY instrument) AS n_all, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS age FROM scored
 WHERE ATR_14 IS NOT NULL AND Return_20d IS NOT NULL AND RSI_14 IS NOT NULL) WHERE n_all >= 60 AND age <= 544""",
)
cte(
    "hits",
    """SELECT e.instrument, e.i, b.i AS j, e.date AS entry_date, b.date AS exit_date, e.close AS entry,
CASE WHEN b.low <= e.close - 2 * e.ATR_14 THEN 'stop' WHEN b.high >= e.close + 4 * e.ATR_14 THEN 'target' WHEN b.Signal = -1 THEN 'signal' WHEN b.i = least(e.i + 40, last_i) THEN 'time' END AS reason,
CASE WHEN b.low <= e.close - 2 * e.ATR_14 THEN e.close - 2 * e.ATR_14 WHEN b.high >= e.close + 4 * e.ATR_14 THEN e.close + 4 * e.ATR_14 ELSE b.close END AS price
FROM (SELECT *, max(i) OVER (PARTITION BY instrument) AS last_i FROM complete) e JOIN complete b ON e.instrument = b.instrument AND b.i BETWEEN e.i + 1 AND e.i + 40
WHERE e.short_ok AND e.ATR_14 > 0""",
)
cte(
    "first_exits",
    "SELECT instrument, i, j, entry_date, exit_date, reason, price / entry - 1 AS ret FROM hits WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, i ORDER BY j) = 1",
)
cte(
    "next_free",
    "SELECT a.instrument, a.i, min(b.i) AS nxt FROM first_exits a LEFT JOIN first_exits b ON a.instrument = b.instrument AND b.i > a.j GROUP BY 1, 2",
)
cte(
    "chosen",
    """--recursive
SELECT instrument, min(i) AS i FROM first_exits GROUP BY instrument
UNION ALL SELECT c.instrument, n.nxt AS i FROM chosen c JOIN next_free n ON c.instrument = n.instrument AND c.i = n.i WHERE n.nxt IS NOT NULL""",
)
cte("record", "SELECT f.*, ret - 0.002::DOUBLE AS net, j - i AS hold FROM first_exits f JOIN chosen USING (instrument, i)")


@register("TRD1_first_exits", f"SELECT instrument, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, entry_date, exit_date, reason, {r('ret', 8)} FROM first_exits")
def _(spark, sf):
    df = out.candidate_exits(signalled(spark, sf))
    return df.select("instrument", big("i"), big("j"), "entry_date", "exit_date", "reason", rnd("ret", 8))


@register("TRD2_non_overlapping", f"SELECT instrument, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, entry_date, exit_date, reason, {r('ret', 8)} FROM record")
def _(spark, sf):
    df = out.without_overlap(out.candidate_exits(signalled(spark, sf)))
    return df.select("instrument", big("i"), big("j"), "entry_date", "exit_date", "reason", rnd("ret", 8))


@register("TRD3_net_return", f"SELECT instrument, entry_date, {r('net', 8, 'ret')}, CAST(hold AS BIGINT) AS hold FROM record")
def _(spark, sf):
    return out.track_record(signalled(spark, sf)).select("instrument", "entry_date", rnd("ret", 8), big("hold"))


def _pf(v: str) -> str:
    return (
        f"CASE WHEN sum({v}) FILTER ({v} <= 0) < 0 THEN coalesce(sum({v}) FILTER ({v} > 0), 0) / abs(sum({v}) FILTER ({v} <= 0)) "
        f"WHEN count(*) FILTER ({v} > 0) > 0 THEN 'Infinity'::DOUBLE ELSE 0 END"
    )


_RECORD = (
    f"count(*) AS n, {r('avg(CAST(net > 0 AS INT))', 8, 'win_rate')}, {r('avg(net)', 8, 'avg_return')}, {r('coalesce(avg(net) FILTER (net > 0), 0)', 8, 'avg_win')}, "
    f"{r('coalesce(avg(net) FILTER (net <= 0), 0)', 8, 'avg_loss')}, {r(_pf('net'), 6, 'profit_factor')}, {r('avg(hold)', 6, 'avg_hold_days')}, {r('max(net)', 8, 'best')}, {r('min(net)', 8, 'worst')}, "
    + ", ".join(f"count(*) FILTER (reason = '{k}') AS n_{k}" for k in ("stop", "target", "signal", "time"))
)


def _show_record(df):
    eight = ("win_rate", "avg_return", "avg_win", "avg_loss", "best", "worst")
    return df.select(
        *[c for c in df.columns if c not in (*eight, "profit_factor", "avg_hold_days")],
        *[rnd(c, 8) for c in eight],
        rnd("profit_factor", 6),
        rnd("avg_hold_days", 6),
    )


@register("TRD4_record_statistics", f"SELECT {_RECORD} FROM record")
def _(spark, sf):
    return _show_record(out.record_stats(out.track_record(signalled(spark, sf))))


@register("REC19_weak_record", f"SELECT instrument, coalesce({_pf('net')} < 1, FALSE) AS weak, {_RECORD} FROM record GROUP BY instrument")
def _(spark, sf):
    stats = out.record_stats(out.track_record(signalled(spark, sf)), ("instrument",))
    return _show_record(idea.weak_record(stats))


# ---- trade log ----

cte(
    "picked",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY Confidence DESC, instrument) AS slot FROM sig WHERE Signal = 1 AND Confidence > 0 AND close > 0) WHERE slot <= 8""",
)
_frac = "least(0.1::DOUBLE * least(greatest(Size_Mult, 0), 1) * (0.5 + 0.5 * least(greatest(Confidence, 0), 1)), 0.1)"
cte(
    "entries",
    f"SELECT instrument, date AS entry_date, close AS entry_price, coalesce(Stop_Loss, close * 0.95) AS stop_loss, 100000 * ({_frac}) / (close * 1.001::DOUBLE) AS shares FROM picked",
)
cte(
    "log",
    """SELECT e.*, x.exit_date, x.exit_price, x.exit_reason FROM entries e JOIN (
 SELECT e.instrument, e.entry_date, b.date AS exit_date,
 CASE WHEN b.date > e.entry_date AND b.low <= e.stop_loss THEN e.stop_loss ELSE b.close END AS exit_price,
 CASE WHEN b.date > e.entry_date AND b.low <= e.stop_loss THEN 'stop_loss' WHEN b.date > e.entry_date AND b.Signal = -1 THEN 'signal_sell' ELSE 'end_of_data' END AS exit_reason
 FROM entries e JOIN sig b ON e.instrument = b.instrument AND b.date >= e.entry_date
 WHERE (b.date > e.entry_date AND (b.low <= e.stop_loss OR b.Signal = -1)) OR b.date = (SELECT max(date) FROM sig)
 QUALIFY row_number() OVER (PARTITION BY e.instrument, e.entry_date ORDER BY b.date) = 1) x USING (instrument, entry_date)""",
)
cte(
    "trades",
    """SELECT *, instrument AS run_id, got - paid AS pnl, (got - paid) / paid AS return_pct, exit_date - entry_date AS holding_days
FROM (SELECT *, shares * entry_price * 1.001::DOUBLE AS paid, shares * exit_price * 0.999::DOUBLE AS got FROM log)""",
)


def trades(spark, sf):
    """Trade log keyed by run (one run per instrument)."""
    needed = ("instrument", "date", "low", "close", "Signal", "Confidence", "Size_Mult", "Stop_Loss", "Regime_Label")
    signals = settle(signalled(spark, sf).select(*needed))  # read for the entries, for their exits and for the last day
    picked = out.buy_candidates(out.with_next_exit(signals))
    log = out.resolve_exits(out.entries_of(picked), signals)
    return out.round_trip(log).withColumn("run_id", F.col("instrument"))


@register("TRD5_daily_buy_candidates", f"SELECT date, instrument, CAST(slot AS BIGINT) AS slot, {r('Confidence', 6)} FROM picked")
def _(spark, sf):
    return out.buy_candidates(signalled(spark, sf)).select("date", "instrument", big("slot"), rnd("Confidence", 6))


@register("TRD6_size_fraction", f"SELECT instrument, date, {r(_frac, 8, 'fraction')} FROM sig")
def _(spark, sf):
    return signalled(spark, sf).select("instrument", "date", rnd(out.size_fraction(), 8, "fraction"))


@register("TRD7_exit_resolution", f"SELECT instrument, entry_date, exit_date, {r('exit_price', 5)}, exit_reason FROM log")
def _(spark, sf):
    return trades(spark, sf).select("instrument", "entry_date", "exit_date", rnd("exit_price", 5), "exit_reason")


@register("TRD8_round_trip", f"SELECT instrument, entry_date, {r('pnl', 4)}, {r('return_pct', 8)}, CAST(holding_days AS BIGINT) AS holding_days FROM trades")
def _(spark, sf):
    return trades(spark, sf).select("instrument", "entry_date", rnd("pnl", 4), rnd("return_pct", 8), big("holding_days"))


LOG_SQL = {
    "n_trades": "count(*)",
    "n_wins": "count(*) FILTER (pnl > 0)",
    "win_rate": "avg(CAST(pnl > 0 AS INT))",
    "avg_win": "coalesce(avg(pnl) FILTER (pnl > 0), 0)",
    "avg_loss": "coalesce(avg(pnl) FILTER (pnl <= 0), 0)",
    "profit_factor": _pf("pnl"),
    "expectancy": "avg(pnl)",
}
LOG_DIGITS = {"win_rate": 8, "avg_win": 4, "avg_loss": 4, "profit_factor": 6, "expectancy": 4}
cte("log_stats", "SELECT run_id, " + ", ".join(f"{v} AS {k}" for k, v in LOG_SQL.items()) + " FROM trades GROUP BY run_id")
cte(
    "streaks",
    """SELECT run_id, max(len) AS max_consecutive_losses FROM (SELECT run_id, g, count(*) FILTER (pnl <= 0) AS len FROM (
SELECT *, sum(CAST(pnl > 0 AS INT)) OVER (PARTITION BY run_id ORDER BY exit_date, entry_date, instrument) AS g FROM trades) GROUP BY run_id, g) GROUP BY run_id""",
)


@register(
    "TRD9_log_statistics",
    "SELECT run_id, n_trades, n_wins, " + ", ".join(r(c, n) for c, n in LOG_DIGITS.items()) + " FROM log_stats",
)
def _(spark, sf):
    return out.log_stats(trades(spark, sf)).select("run_id", "n_trades", "n_wins", *[rnd(c, n) for c, n in LOG_DIGITS.items()])


@register("TRD10_longest_losing_streak", "SELECT run_id, max_consecutive_losses FROM streaks")
def _(spark, sf):
    return out.longest_losing_streak(trades(spark, sf)).withColumn("max_consecutive_losses", big("max_consecutive_losses"))


@register(
    "TRD10_longest_losing_streak_by_regime",
    """SELECT entry_regime AS run_id, max(len) AS max_consecutive_losses FROM (SELECT entry_regime, g, count(*) FILTER (pnl <= 0) AS len FROM (
SELECT *, sum(CAST(pnl > 0 AS INT)) OVER (PARTITION BY entry_regime ORDER BY exit_date, entry_date, instrument) AS g
FROM trades JOIN (SELECT instrument, date AS entry_date, Regime_Label AS entry_regime FROM sig) USING (instrument, entry_date)) GROUP BY entry_regime, g) GROUP BY entry_regime""",
)
def _(spark, sf):
    df = trades(spark, sf).withColumn("run_id", F.col("entry_regime"))
    return out.longest_losing_streak(df).withColumn("max_consecutive_losses", big("max_consecutive_losses"))


@register("TRD11_pnl_series", f"SELECT run_id, exit_date, entry_date, instrument, {r('pnl', 4)}, {r('return_pct', 8)}, CAST(holding_days AS BIGINT) AS holding_days, exit_reason, pnl >= 0 AS won FROM trades")
def _(spark, sf):
    df = out.pnl_series(trades(spark, sf))
    return df.withColumns({"pnl": F.round("pnl", 4), "return_pct": F.round("return_pct", 8), "holding_days": F.col("holding_days").cast("bigint")})
