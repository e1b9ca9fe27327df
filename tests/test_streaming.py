"""Streams against their batch twins, on files that arrive out of order."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.portfolio import live_value, mark_to_market
from barloom.streaming import quotes as live

from .conftest import SMALL


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("quotes"))
    df = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.col("user_id").cast("string").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last_price")
    )
    df.repartition(5).write.mode("append").parquet(path)
    return path


def drain(df, mode, name, tmp_path, spark):
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return spark.table(name)


def test_latest_quote_and_change(spark, arrivals, tmp_path):
    stream = live.read_stream(spark, arrivals, live.SCHEMA, "60 days", 2)
    got = drain(live.latest(stream), "complete", "newest", tmp_path, spark)
    want = live.latest(spark.read.parquet(arrivals))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    closes = spark.createDataFrame([("0", 10.0), ("1", 0.0), ("2", None)], "instrument string, close double")
    rows = {r.instrument: r for r in live.with_change(got, closes).collect()}
    assert rows["0"].change == pytest.approx(rows["0"].last_price - 10)
    assert rows["1"].change == 0 and rows["1"].previous_close == rows["1"].last_price
    assert rows["2"].change_pct == 0


def test_day_range(spark, arrivals, tmp_path):
    stream = live.read_stream(spark, arrivals, live.SCHEMA, "60 days", 2)
    got = drain(live.day_range(stream), "complete", "ranges", tmp_path, spark)
    want = live.day_range(spark.read.parquet(arrivals))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_quotes_expire_in_event_time(spark, tmp_path):
    path = tmp_path / "in"
    base = pd.Timestamp("2024-01-30 06:00:00")
    batches = [[("a", 0, 1.0), ("b", 0, 5.0)], [("b", 40, 6.0)], [("b", 80, 7.0)], [("b", 130, 8.0)], [("b", 131, 8.5)]]
    for n, rows in enumerate(batches):
        pdf = pd.DataFrame([(k, base + pd.Timedelta(seconds=s), p) for k, s, p in rows], columns=["instrument", "ts", "last_price"])
        spark.createDataFrame(pdf, live.SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    stream = live.read_stream(spark, str(path), live.SCHEMA, "1 second", 1)
    rows = drain(live.expiring(stream), "update", "states", tmp_path, spark).toPandas()
    a = rows[rows.instrument == "a"]
    assert a.state.tolist() == ["live", "stale"] and a.last_price.tolist() == [1.0, 1.0]
    assert "stale" not in rows[rows.instrument == "b"].state.tolist()
    assert rows[rows.instrument == "b"].last_price.max() == 8.5


def test_portfolios_are_revalued_per_batch(spark, arrivals, tmp_path):
    held = spark.createDataFrame(
        [("p", "0", 100.0, 2.0), ("p", "1", 100.0, None), ("q", "2", 50.0, 1.0)], "portfolio_id string, instrument string, amount double, quantity double"
    )
    closes = spark.createDataFrame([("0", 10.0), ("1", 20.0), ("2", 5.0)], "instrument string, close double")
    stream = live.read_stream(spark, arrivals, live.SCHEMA, "60 days", 2)
    as_of = F.lit(spark.read.parquet(arrivals).agg(F.max("ts")).first()[0])  # the quotes of one moment are fresh
    query = live.refresh_portfolios(stream, held, closes, str(tmp_path / "values"), str(tmp_path / "state"), once=True, as_of=as_of)
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "values"))
    newest = out.filter(F.col("batch_id") == out.agg(F.max("batch_id")).scalar()).drop("batch_id")
    now = live.with_staleness(live.latest(spark.read.parquet(arrivals)), as_of)
    want = {r.portfolio_id: r.live_value for r in live_value(mark_to_market(held, now, closes)).collect()}
    assert {r.portfolio_id: r.live_value for r in newest.collect()} == pytest.approx(want)


def test_old_quotes_leave_no_value(spark):
    held = spark.createDataFrame([("p", "0", 100.0, 2.0)], "portfolio_id string, instrument string, amount double, quantity double")
    closes = spark.createDataFrame([("0", 10.0)], "instrument string, close double")
    quote = spark.sql("SELECT '0' AS instrument, timestamp'2024-01-30 06:00:00' AS ts, 11D AS last_price")
    values = {}
    for at in ("2024-01-30 06:00:30", "2024-01-30 09:00:00"):
        now = live.with_staleness(quote, F.lit(at).cast("timestamp"))
        values[at] = live_value(mark_to_market(held, now, closes)).collect()[0].live_value
    assert values == {"2024-01-30 06:00:30": 22.0, "2024-01-30 09:00:00": None}


def test_a_restart_leaves_each_row_once(spark, arrivals, tmp_path):
    """A batch that was written but not noted as done is run again into its own folder."""
    out, state = str(tmp_path / "out"), tmp_path / "state"
    ranges = lambda: live.day_range(live.read_stream(spark, arrivals, live.SCHEMA, "60 days", 2)).select("instrument", "day", "volume")
    first = live.drain(ranges(), out, str(state)).toPandas()
    last = max(int(f.name) for f in (state / "commits").iterdir() if f.name.isdigit())
    (state / "commits" / str(last)).unlink()
    for crc in (state / "commits").glob(f".{last}.crc"):
        crc.unlink()
    again = live.drain(ranges(), out, str(state)).toPandas()
    key = ["instrument", "day", "volume", "batch_id"]
    assert sorted(map(str, first[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    newest = again.sort_values("batch_id").drop_duplicates(["instrument", "day"], keep="last")
    want = live.day_range(spark.read.parquet(arrivals)).toPandas()
    assert newest.volume.sum() == want.volume.sum() and len(newest) == len(want)
