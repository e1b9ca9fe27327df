"""Bar tables on disk, calendar rules, walk-forward windows, registry hygiene."""

from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.operators import walkforward as wf
from barloom.operators.indicators import indicators
from barloom.operators.returns import prepare
from barloom.sources import bars as store
from barloom.sources import calendar as cal
from barloom.sources.panels import BARS

from .bars import walk


def test_round_trip_prunes_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    df = spark.createDataFrame(pd.concat([walk("A", 600, 1), walk("B", 600, 2)]), BARS)
    store.write_bars(df, path)
    back = store.scan_bars(spark, path, universe=["A"], start="2019-01-01", end="2019-12-31")
    want = df.filter("instrument = 'A' AND year(date) = 2019")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date,2019-01-01)" in plan


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_upsert_of_a_part_of_a_year_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "bars")
    df = spark.createDataFrame(pd.concat([walk("A", 600, 1), walk("B", 600, 2)]), BARS)
    store.write_bars(df, path)
    before = df.select("date").distinct().orderBy("date").collect()
    late = before[300].date
    week = df.filter((F.col("date") >= F.lit(late)) & (F.col("date") < F.lit(late) + F.expr("INTERVAL 7 DAYS")) & (F.col("instrument") == "A"))
    fixed = week.withColumn("close", F.lit(1.0))
    new = spark.createDataFrame(walk("C", 10, 3), BARS)
    store.upsert_bars(fixed.unionByName(new).unionByName(new.limit(3)), path)
    want = df.join(fixed.select("instrument", "date"), ["instrument", "date"], "left_anti").unionByName(fixed).unionByName(new)
    assert same(store.scan_bars(spark, path), want)
    store.upsert_bars(fixed.unionByName(new), path)  # the same again
    assert same(store.scan_bars(spark, path), want)
    store.upsert_bars(df.limit(0), path)
    assert same(store.scan_bars(spark, path), want)


def test_upsert_makes_a_table_and_leaves_other_years_untouched(spark, tmp_path):
    path = str(tmp_path / "bars")
    df = spark.createDataFrame(walk("A", 600, 1), BARS)
    store.upsert_bars(df, path)
    assert same(store.scan_bars(spark, path), df)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    year = df.agg(F.max(F.year("date"))).first()[0]
    store.upsert_bars(df.filter(F.year("date") == year).limit(2), path)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    untouched = {f for f in files if f"year={year}" not in f}
    assert untouched and all(after[f] == files[f] for f in untouched)


def test_upsert_is_repeatable_after_a_lost_job(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bars")
    df = spark.createDataFrame(walk("A", 300, 1), BARS)
    store.write_bars(df, path)
    fixed = df.filter("month(date) = 3").withColumn("close", F.lit(1.0))
    want = df.join(fixed.select("instrument", "date"), ["instrument", "date"], "left_anti").unionByName(fixed)

    def lost(*_):
        raise RuntimeError("lost")

    keep = store._set_state
    monkeypatch.setattr(store, "_set_state", lambda s, p, state: lost() if state == "ready" else keep(s, p, state))
    with pytest.raises(RuntimeError):  # staged, not yet marked: the table is as it was
        store.upsert_bars(fixed, path)
    assert same(store.scan_bars(spark, path), df)
    monkeypatch.setattr(store, "_set_state", lambda s, p, state: lost() if state == "applied" else keep(s, p, state))
    with pytest.raises(RuntimeError):  # marked and carried over, but not noted as done
        store.upsert_bars(fixed, path)
    monkeypatch.setattr(store, "_set_state", keep)
    # as if the carrying over had been lost in between
    store._by_year(df.limit(5)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    store.recover_bars(spark, path)
    assert same(store.scan_bars(spark, path), want)
    store.upsert_bars(fixed, path)
    assert same(store.scan_bars(spark, path), want)


def test_bucketed_bars_need_no_exchange(spark, tmp_path):
    df = spark.createDataFrame(pd.concat([walk("A", 300, 1), walk("B", 300, 2), walk("C", 300, 3)]), BARS)
    names = len(spark.catalog.listTables())
    bars = store.cluster_bars(df, str(tmp_path / "bucketed"), 4)
    assert len(spark.catalog.listTables()) == names  # nothing stays in the catalog
    latest = sg.latest(sg.signals(rg.rule_regime(indicators(prepare(bars)))))
    assert latest.count() == 3
    assert "Exchange" not in latest._jdf.queryExecution().optimizedPlan().toString()
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    other = sg.latest(sg.signals(rg.rule_regime(indicators(prepare(df)))))
    assert same(latest, other)


def test_csv_scan_uses_the_fixed_schema(spark, tmp_path):
    walk("A", 5, 1).to_csv(tmp_path / "a.csv", index=False)
    df = store.scan_bars(spark, str(tmp_path), format="csv")
    assert df.count() == 5 and dict(df.dtypes)["date"] == "date"


def test_one_bar_per_day(spark):
    rows = [("A", date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0), ("A", date(2020, 1, 1), 1.0, 2.0, 0.5, 1.6, 10.0)]
    got = store.one_bar_per_day(spark.createDataFrame(rows, BARS)).collect()
    assert len(got) == 1 and got[0].close == 1.6


def test_calendar_walks_back_over_weekends_and_holidays(spark):
    cases = [
        (datetime(2024, 1, 29, 8, 0), date(2024, 1, 25)),  # Monday before the open, Friday was a holiday
        (datetime(2024, 1, 29, 9, 15), date(2024, 1, 29)),
        (datetime(2024, 1, 26, 12, 0), date(2024, 1, 25)),
        (datetime(2025, 10, 22, 12, 0), date(2025, 10, 20)),
        (datetime(2024, 1, 28, 12, 0), date(2024, 1, 25)),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "t timestamp_ntz")
    got = [r[0] for r in df.select(cal.last_trading_day(F.col("t"))).collect()]
    assert got == [c[1] for c in cases]
    edges = spark.createDataFrame([(datetime(2024, 1, 29, 15, 30),), (datetime(2024, 1, 29, 15, 30, 0, 1),), (datetime(2024, 1, 29, 9, 14, 59),)], "t timestamp_ntz")
    assert [r[0] for r in edges.select(cal.is_session_open(F.col("t"))).collect()] == [True, False, False]


def test_extend_and_reconcile(spark):
    base = spark.createDataFrame([("A", 1), ("B", 1)], "instrument string, v int")
    extra = spark.createDataFrame([("B", 2), ("C", 2)], "instrument string, v int")
    assert sorted(store.extend(base, extra).collect()) == [("A", 1), ("B", 2), ("C", 2)]
    got = store.reconcile(spark.createDataFrame([("A",), ("Z",)], "instrument string"), base).collect()
    assert sorted((r.instrument, r.loaded) for r in got) == [("A", True), ("Z", False)]


def _windows(start, end, train, test, step, anchored):
    off = lambda y: pd.DateOffset(years=int(y), months=round((y - int(y)) * 12))
    start, end = pd.Timestamp(start), pd.Timestamp(end)
    cursor, out = start + off(train), []
    if cursor >= end:
        return out
    while cursor + pd.DateOffset(months=test) <= end + pd.DateOffset(days=1):
        begin = start if anchored else max(cursor - off(train), start)
        out.append((begin.date(), cursor.date(), min(cursor + pd.DateOffset(months=test), end).date()))
        cursor += pd.DateOffset(months=step)
    return out


@pytest.mark.parametrize(
    "start,end,train,test,step,anchored",
    [
        ("2015-01-31", "2020-03-15", 1.5, 1, 1, False),
        ("2015-08-31", "2020-03-15", 3, 6, 6, True),
        ("2015-08-30", "2019-02-28", 3, 6, 3, True),
        ("2019-01-01", "2019-06-01", 3, 6, 6, True),
    ],
)
def test_window_plan_follows_calendar_months(spark, start, end, train, test, step, anchored):
    bars = spark.createDataFrame([(date.fromisoformat(start),), (date.fromisoformat(end),)], "date date")
    got = wf.plan(bars, train, test, step, anchored).orderBy("window_id").collect()
    assert [(r.train_start, r.test_start, r.test_end) for r in got] == _windows(start, end, train, test, step, anchored)


def test_chained_windows_drop_the_overlap(spark):
    rows = [("r", 1, date(2020, 1, 1), 100.0), ("r", 1, date(2020, 1, 2), 110.0), ("r", 2, date(2020, 1, 2), 100.0), ("r", 2, date(2020, 1, 3), 90.0)]
    got = wf.chain(spark.createDataFrame(rows, "run_id string, window_id int, date date, equity double")).orderBy("date").collect()
    assert [round(r.equity, 9) for r in got] == [100.0, 110.0, 99.0]


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 170


@pytest.mark.parametrize("anchored", [True, False])
def test_rule_signals_repeat_no_train_rows(spark, anchored):
    """Half a year of training is less than the squeeze looks back, so a window's start must cut the widths."""
    bars = spark.createDataFrame(pd.concat([walk("A", 560, 3), walk("B", 430, 4), walk("C", 90, 5), walk("D", 203, 6)]), BARS)
    features = indicators(prepare(bars)).cache()
    windows = wf.plan(features, 0.5, 3, anchored=anchored)
    got = wf.out_of_sample(features, windows, "ma_crossover")
    sliced = rg.label(wf.slices(features, windows), "ma_crossover", wf.KEYS, F.col("is_train"))
    want = sg.signals(sliced, keys=wf.KEYS).filter("is_test").select(*sorted(got.columns))
    order = ["window_id", "instrument", "date"]
    pd.testing.assert_frame_equal(got.select(*sorted(got.columns)).orderBy(*order).toPandas(), want.orderBy(*order).toPandas())
    assert want.count() > 300 and want.filter("Regime = 1").count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("window_id" in line for line in plan.splitlines() if "windowspecdefinition" in line)


@pytest.mark.parametrize("anchored", [True, False])
def test_model_signals_gather_a_series_once(spark, anchored):
    """The same labels as with every window's slice repeated, estimated and decoded on its own; one series has too few usable train rows."""
    bars = spark.createDataFrame(pd.concat([walk("A", 560, 3), walk("B", 430, 4), walk("C", 90, 5), walk("D", 203, 6), walk("E", 330, 7)]), BARS)
    features = indicators(prepare(bars))
    few, some = (F.col("instrument") == "E") & (F.dayofmonth("date") > 9), (F.col("instrument") == "A") & (F.dayofmonth("date") % 9 == 2)
    hole = few | some  # rows that no model can label
    features = features.withColumn("Volatility_20", F.when(~hole, F.col("Volatility_20"))).cache()
    windows = wf.plan(features, 0.5, 3, anchored=anchored)
    got = wf.out_of_sample(features, windows, "hmm")
    sliced = wf.slices(features, windows)
    model, decoded = rg.decode_hmm(sliced, wf.KEYS, F.col("is_train"))
    ranked = rg.order_posteriors(rg.order_states(decoded, "state", wf.KEYS, F.col("_fit"))).drop("state", "p0", "p1", "p2")
    want = sg.signals(rg.model_or_rule(rg.spread_both(ranked, keys=wf.KEYS)), keys=wf.KEYS).filter("is_test")
    order, names = ["window_id", "instrument", "date"], sorted(got.columns)
    got, want = (df.select(*names).orderBy(*order).toPandas() for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=1e-8)
    assert got["Regime_Prob_Bull"].isna().any() and got["Regime_Prob_Bull"].notna().sum() > 300
    plan = wf.out_of_sample(features, windows, "hmm")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("window_id" in line for line in plan.splitlines() if "windowspecdefinition" in line)
