"""Trade outcomes against a plain loop, and streaks against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ideas as idea
from barloom.operators import outcomes as out
from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.operators.indicators import indicators
from barloom.operators.ideas import short_eligible
from barloom.operators.returns import prepare
from barloom.sources.panels import BARS

from .bars import walk


@pytest.fixture(scope="module")
def signals(spark):
    pdf = pd.concat([walk(k, 620, i, 0.001, 0.013) for i, k in enumerate("ABC")])
    df = sg.signals(rg.rule_regime(indicators(prepare(spark.createDataFrame(pdf, BARS)))))
    return df.cache()


def test_track_record_equals_the_bar_by_bar_loop(signals):
    got = out.track_record(signals).toPandas().sort_values(["instrument", "i"])
    rows = signals.withColumn("ok", short_eligible()).orderBy("instrument", "date").toPandas()
    want = []
    for name, d in rows.groupby("instrument"):
        d = d.dropna(subset=list(out.NEEDED)).tail(544).reset_index(drop=True)
        i = 0
        while i < len(d) - 1:
            if not d.ok[i] or d.ATR_14[i] <= 0:
                i += 1
                continue
            entry, atr = d.close[i], d.ATR_14[i]
            for j in range(i + 1, min(i + 41, len(d))):
                if d.low[j] <= entry - 2 * atr:
                    price, why = entry - 2 * atr, "stop"
                    break
                if d.high[j] >= entry + 4 * atr:
                    price, why = entry + 4 * atr, "target"
                    break
                if d.Signal[j] == -1:
                    price, why = d.close[j], "signal"
                    break
            else:
                j = min(i + 40, len(d) - 1)
                price, why = d.close[j], "time"
            want.append((name, i, j, why, price / entry - 1 - 0.002))
            i = j + 1
    assert len(want) > 10
    assert list(zip(got.instrument, got.i, got.j, got.reason)) == [w[:4] for w in want]
    np.testing.assert_allclose(got.ret, [w[4] for w in want], atol=1e-12)


def test_exits_follow_stop_then_sell_then_end(signals):
    marked = out.with_next_exit(signals)
    log = out.round_trip(out.resolve_exits(out.entries_of(out.buy_candidates(marked)), signals)).toPandas()
    rows = {k: d.set_index("date") for k, d in signals.toPandas().groupby("instrument")}
    assert len(log) > 20
    for t in log.itertuples():
        later = rows[t.instrument].loc[lambda d: d.index > t.entry_date].sort_index()
        for day, bar in later.iterrows():
            if bar.low <= t.stop_loss:
                want = (day, t.stop_loss, "stop_loss")
                break
            if bar.Signal == -1:
                want = (day, bar.close, "signal_sell")
                break
        else:
            last = rows[t.instrument].sort_index().iloc[-1]
            want = (max(rows[t.instrument].index), last.close, "end_of_data")
        assert (t.exit_date, t.exit_reason) == (want[0], want[2])
        assert t.exit_price == pytest.approx(want[1])


def test_losing_streak_chains_over_days(spark):
    rng = np.random.default_rng(4)
    frames = []
    for run, p in (("a", 0.8), ("b", 0.5), ("c", 1.0), ("d", 0.0)):
        n = 400
        frames.append(
            pd.DataFrame(
                {
                    "run_id": run,
                    "exit_date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 60, n), unit="D"),
                    "entry_date": pd.to_datetime("2019-01-01") + pd.to_timedelta(rng.integers(0, 300, n), unit="D"),
                    "instrument": [f"i{k}" for k in range(n)],
                    "pnl": np.where(rng.random(n) < p, -1.0, 1.0),
                }
            )
        )
    pdf = pd.concat(frames)
    got = out.longest_losing_streak(spark.createDataFrame(pdf)).toPandas().set_index("run_id")["max_consecutive_losses"]
    for run, d in pdf.sort_values(["exit_date", "entry_date", "instrument"]).groupby("run_id"):
        best = here = 0
        for v in d.pnl:
            here = here + 1 if v <= 0 else 0
            best = max(best, here)
        assert got[run] == best


def test_profit_factor_edges(spark):
    df = spark.createDataFrame([("w", 1.0), ("l", -1.0), ("m", 2.0), ("m", -4.0)], "run_id string, pnl double")
    got = {r.run_id: r.profit_factor for r in out.log_stats(df).collect()}
    assert got == {"w": float("inf"), "l": 0.0, "m": 0.5}


def test_size_is_capped(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (0.5, 0.7), (-1.0, 1.0)], "Confidence double, Size_Mult double")
    got = [r[0] for r in df.select(out.size_fraction()).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.0525, 0.05])


def test_soft_gate_tilts_with_the_posterior(spark):
    df = spark.createDataFrame(
        [(0.25, "BULL", 1.0), (0.25, "BULL", None), (0.25, "BULL", 0.0), (-0.2, "BEAR", 0.0), (-0.2, "BEAR", 1.0), (0.41, None, None)],
        "Score_Raw double, Regime_Label string, Regime_Prob_Bull double",
    )
    assert [r.Signal for r in sg.gate(df).collect()] == [1, 0, 0, -1, 0, 1]


def test_look_ahead_needs_no_window_of_rows(spark, signals):
    found = out.candidate_exits(spark.createDataFrame([], signals.schema))
    assert "Window [" not in found._jdf.queryExecution().analyzed().toString()


def test_first_exits_of_several_series_in_one_batch(spark, signals):
    """Every entry against a loop, overlapping ones too; an array fold per entry, or a filter on signals, would show in the plan."""
    signals = signals.withColumn("RSI_14", F.when(F.dayofmonth("date") == 7, float("nan")).when(F.dayofmonth("date") != 9, F.col("RSI_14")))
    found = out.candidate_exits(signals)
    rows = signals.withColumn("ok", short_eligible()).orderBy("instrument", "date").toPandas()
    want = []
    for name, d in rows.groupby("instrument"):
        d = d.dropna(subset=list(out.NEEDED)).tail(544).reset_index(drop=True)
        for i in d.index[d.ok & (d.ATR_14 > 0)]:
            ahead = d.iloc[i + 1 : i + 41]
            low, high = d.close[i] - 2 * d.ATR_14[i], d.close[i] + 4 * d.ATR_14[i]
            hit = ahead.index[(ahead.low <= low) | (ahead.high >= high) | (ahead.Signal == -1)]
            if len(ahead):
                want.append((name, i, hit[0] if len(hit) else ahead.index[-1]))
    got = found.orderBy("instrument", "i").toPandas()
    assert list(zip(got.instrument, got.i, got.j)) == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Signal" not in "".join(line for line in plan.splitlines() if "Filter" in line)


def test_ranking_works_out_the_list_once(signals):
    listed = idea.ideas(idea.snapshot(signals))
    got = idea.ranked(listed)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(-r.conv_rank, -r.Score, r.instrument) for r in got.collect()]
    assert rows == sorted(rows) and len(rows) == listed.count()
