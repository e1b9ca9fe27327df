"""Registered queries: walk-forward evaluation on daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import settle
from ..operators import performance as perf
from ..operators import walkforward as wf
from ..sources import panels
from . import decision_sql  # noqa: F401
from . import regime_sql as rs
from .common import big, cte, r, rnd, sql
from .decision_sql import NAME, signals_ctes
from .decisions import GIVEN
from .prices import features
from .price_sql import full
from .runs import RATIO, metric_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


def _plan_sql(anchored: bool) -> str:
    start = "a" if anchored else "greatest(CAST(ts - INTERVAL 36 MONTH AS DATE), a)"
    return f"""SELECT CAST(k + 1 AS INT) AS window_id, {start} AS train_start, ts AS train_end, ts AS test_start, least(CAST(ts + INTERVAL 6 MONTH AS DATE), b) AS test_end
FROM (SELECT a, b, k, CAST(a + INTERVAL 36 MONTH + k * INTERVAL 6 MONTH AS DATE) AS ts FROM (SELECT min(date) AS a, max(date) AS b FROM bars), range(0, 200) g(k)) WHERE ts + INTERVAL 6 MONTH <= b + INTERVAL 1 DAY"""


cte("wins", _plan_sql(True))
cte("rolling_wins", _plan_sql(False))
_WIN = "CAST(window_id AS BIGINT) AS window_id, train_start, train_end, test_start, test_end"


def _plan(name: str, anchored: bool, source: str) -> None:
    @register(name, f"SELECT {_WIN} FROM {source}")
    def _(spark, sf):
        df = wf.plan(panels.daily_bars(spark, sf), anchored=anchored)
        return df.withColumn("window_id", big("window_id"))


_plan("WF1_anchored_plan", True, "wins")
_plan("WF1_rolling_plan", False, "rolling_wins")


def slice_sql(columns: str, source: str) -> str:
    """Slices carry the window inside the instrument, so the per-instrument SQL applies unchanged."""
    return f"""SELECT * FROM (SELECT *, sum(CAST(is_train AS INT)) OVER (PARTITION BY instrument) AS n_train, sum(CAST(NOT is_train AS INT)) OVER (PARTITION BY instrument) AS n_test FROM (
SELECT window_id, window_id || ':' || f.instrument AS instrument, f.instrument AS name, date <= train_end AS is_train, {columns} FROM {source} f JOIN wins ON date BETWEEN train_start AND test_end)) WHERE n_train >= 100 AND n_test >= 10"""


cte("sliced", slice_sql("f.* EXCLUDE (instrument)", "feat"))
cte(
    "wf_reg",
    f"""SELECT *, {NAME.format('Regime')} AS Regime_Label FROM (SELECT *, CASE WHEN coalesce(w12 < {full('quantile_cont', 'w12', 252, 60).replace('quantile_cont(w12)', 'quantile_cont(w12, 0.2)')}, FALSE) THEN 1
WHEN close > MA_200 AND MA_50 > MA_200 THEN 2 WHEN close > MA_200 THEN 1 ELSE 0 END AS Regime FROM (SELECT *, round(BB_Width, 12) AS w12 FROM sliced))""",
)
signals_ctes("wf_", "wf_reg")
cte("wf_test", "SELECT * FROM wf_sig WHERE NOT is_train")


@register("WF2_window_slices", "SELECT CAST(window_id AS BIGINT) AS window_id, name AS instrument, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test, min(date) AS first_day, max(date) AS last_day FROM sliced GROUP BY 1, 2")
def _(spark, sf):
    bars = panels.daily_bars(spark, sf)
    df = wf.slices(bars, wf.plan(bars))
    return df.groupBy(big("window_id"), "instrument").agg(
        F.count_if("is_train").alias("n_train"), F.count_if("is_test").alias("n_test"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


def test_signals(spark, sf, method="ma_crossover"):
    return wf.out_of_sample(features(spark, sf), wf.plan(panels.daily_bars(spark, sf)), method)


@register("WF3_rule_signals", f"SELECT CAST(window_id AS BIGINT) AS window_id, name AS instrument, date, Regime_Label, CAST(Signal AS BIGINT) AS Signal, {r('Confidence', 6)}, {r('Stop_Loss', 5)} FROM wf_test")
def _(spark, sf):
    return test_signals(spark, sf).select(big("window_id"), "instrument", "date", "Regime_Label", big("Signal"), rnd("Confidence", 6), rnd("Stop_Loss", 5))


rs.hmm_ctes("wh_", "sliced", "is_train")
signals_ctes("wg_", "wh_hmm", "Regime_Prob_Bull")


@register("WF3_given_model_signals", f"SELECT CAST(window_id AS BIGINT) AS window_id, name AS instrument, date, Regime_Label, CAST(Signal AS BIGINT) AS Signal, {r('Confidence', 6)} FROM wg_sig WHERE NOT is_train")
def _(spark, sf):
    windows = wf.plan(panels.daily_bars(spark, sf))
    out = wf.out_of_sample(features(spark, sf), windows, parameters=GIVEN)
    return out.select(big("window_id"), "instrument", "date", "Regime_Label", big("Signal"), rnd("Confidence", 6))


@register("WF3_hmm_signals")
def _(spark, sf):
    return test_signals(spark, sf, "hmm").select(big("window_id"), "instrument", "date", "Regime_Label", big("Signal"), rnd("Confidence", 6))


# Per-window curves of every instrument, each window restarting at 100,000.
cte(
    "curves",
    "SELECT window_id, name AS run_id, date, 100000 * close / first_value(close) OVER (PARTITION BY instrument ORDER BY date) AS equity FROM sliced WHERE NOT is_train",
)
cte(
    "chained",
    """SELECT run_id, date, equity / f0 * base * growth AS equity FROM curves JOIN (
SELECT run_id, window_id, f0, first_value(f0) OVER (PARTITION BY run_id ORDER BY window_id) AS base, coalesce(product(l0 / f0) OVER (PARTITION BY run_id ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS growth
FROM (SELECT run_id, window_id, min_by(equity, date) AS f0, max_by(equity, date) AS l0 FROM curves GROUP BY 1, 2)) USING (run_id, window_id)""",
)
cte(
    "oos",
    "SELECT *, equity / peak - 1 AS dd FROM (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY run_id ORDER BY date) - 1, 0) AS ret, max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT run_id, date, round(equity, 6) AS equity FROM chained))",
)
cte("oos_metrics", metric_sql("oos"))


def chained(spark, sf):
    bars = panels.daily_bars(spark, sf)
    test = wf.slices(bars, wf.plan(bars)).filter("is_test")
    first = F.first("close").over(Window.partitionBy("window_id", "instrument").orderBy("date"))
    curves = test.select("window_id", F.col("instrument").alias("run_id"), "date", (100_000 * F.col("close") / first).alias("equity"))
    return wf.chain(curves)


@register("WF4_chained_equity", f"SELECT run_id, date, {r('equity', 3)} FROM chained")
def _(spark, sf):
    return chained(spark, sf).select("run_id", "date", rnd("equity", 3))


@register("WF5_out_of_sample_metrics", "SELECT run_id, " + ", ".join(r(c, n) for c, n in RATIO.items()) + " FROM oos_metrics")
def _(spark, sf):
    # Rounded, so that an unchanged price stays unchanged after rescaling.
    curve = chained(spark, sf).withColumn("equity", F.round("equity", 6))
    return perf.metrics(curve).select("run_id", *[rnd(c, n) for c, n in RATIO.items()])


cte("wf_picked", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, date ORDER BY Confidence DESC, name) AS slot FROM wf_test WHERE Signal = 1 AND Confidence > 0 AND close > 0) WHERE slot <= 8")
_frac = "least(0.1::DOUBLE * least(greatest(Size_Mult, 0), 1) * (0.5 + 0.5 * least(greatest(Confidence, 0), 1)), 0.1)"
cte("wf_entries", f"SELECT window_id, instrument, date AS entry_date, close AS entry_price, Stop_Loss AS stop_loss, 100000 * ({_frac}) / (close * 1.001::DOUBLE) AS shares FROM wf_picked")
cte(
    "wf_trades",
    """SELECT *, shares * exit_price * 0.999::DOUBLE - shares * entry_price * 1.001::DOUBLE AS pnl FROM wf_entries JOIN (
 SELECT e.instrument, e.entry_date, CASE WHEN b.date > e.entry_date AND b.low <= e.stop_loss THEN e.stop_loss ELSE b.close END AS exit_price
 FROM wf_entries e JOIN wf_test b ON e.instrument = b.instrument AND b.date >= e.entry_date JOIN (SELECT window_id, max(date) AS last_day FROM wf_test GROUP BY 1) m ON e.window_id = m.window_id
 WHERE (b.date > e.entry_date AND (b.low <= e.stop_loss OR b.Signal = -1)) OR b.date = last_day QUALIFY row_number() OVER (PARTITION BY e.instrument, e.entry_date ORDER BY b.date) = 1) x USING (instrument, entry_date)""",
)
cte(
    "wf_index",
    """SELECT *, equity / peak - 1 AS dd FROM (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY run_id ORDER BY date) - 1, 0) AS ret, max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (
SELECT window_id AS run_id, date, 100000 * exp(sum(ln(1 + x)) OVER (PARTITION BY window_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM (SELECT window_id, date, avg(coalesce(Daily_Return, 0)) AS x FROM wf_test GROUP BY 1, 2)))""",
)
cte("wf_metrics", metric_sql("wf_index"))


@register(
    "WF6_window_summary",
    f"""SELECT CAST(w.window_id AS BIGINT) AS window_id, train_start, train_end, test_start, test_end, coalesce(n_trades, 0) AS n_trades, {r('coalesce(win_rate, 0)', 6, 'win_rate')}, {r('total_return', 6)}, {r('sharpe', 6)}, {r('max_drawdown', 6, 'max_dd')}
FROM wins w JOIN wf_metrics m ON w.window_id = m.run_id LEFT JOIN (SELECT window_id, count(*) AS n_trades, avg(CAST(pnl > 0 AS INT)) AS win_rate FROM wf_trades GROUP BY 1) t ON w.window_id = t.window_id""",
)
def _(spark, sf):
    windows = wf.plan(panels.daily_bars(spark, sf))
    rows = wf.out_of_sample(features(spark, sf), windows, "ma_crossover")
    df = wf.summary(windows, settle(rows.select(*wf.SUMMARISED)))
    return df.select(
        big("window_id"), "train_start", "train_end", "test_start", "test_end", big("n_trades"), *[rnd(c, 6) for c in ("win_rate", "total_return", "sharpe", "max_dd")]
    )
