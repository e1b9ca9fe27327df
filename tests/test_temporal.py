"""Joins in time against pandas and loops, and how they spread hot keys."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import temporal as tm

START = datetime(2020, 1, 1)


def table(n, seed, hot=0.9):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        key = "hot" if rng.random() < hot else rng.choice("abc")
        rows.append((key, START + timedelta(hours=rng.randint(0, 24 * 200)), k))
    return rows


@pytest.mark.parametrize("part_rows", [500_000, 7])
def test_asof_equals_pandas_with_ties_and_a_hot_key(spark, part_rows):
    left, right = table(400, 1), table(300, 2)
    left += [("hot", START + timedelta(hours=100), 1000 + k) for k in range(50)]  # an instant with many rows
    right += [("hot", START + timedelta(hours=100), 2000), ("hot", START + timedelta(hours=100), 1999), ("z", START, 5)]
    left += [("never", START, 3000), (None, START, 3001), ("hot", None, 3002)]
    right += [(None, START, 7), ("hot", None, 8)]
    a = spark.createDataFrame(left, "name string, ts timestamp, id int")
    b = spark.createDataFrame(right, "name string, ts timestamp, value int")
    got = tm.asof_join(a, b, ["name"], "ts", ["value"], slice_days=5, part_rows=part_rows).toPandas()
    assert list(got.columns) == ["name", "ts", "id", "ts_found", "value"] and len(got) == len(left)
    best = {}
    for name, ts, v in right:
        if name and ts:
            best.setdefault(name, {}).setdefault(ts, []).append(v)
    for row in got.itertuples():
        known = {t: max(v) for t, v in best.get(row.name, {}).items()} if row.name is not None and not pd.isna(row.ts) else {}
        before = [t for t in known if t <= row.ts] if known else []
        if before:
            assert (row.ts_found, row.value) == (max(before), known[max(before)])
        else:
            assert pd.isna(row.ts_found) and pd.isna(row.value)


def test_asof_spreads_one_instrument_over_tasks(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 50)).otherwise("hot").alias("name"),
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int") * 20)).alias("ts"),
        "id",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = tm.asof_join(rows, rows.withColumn("value", F.col("id")), ["name"], "ts", ["value"], slice_days=3)
        assert out.filter("value <> id or value is null").count() == 0
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).agg(F.count("value")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == n and max(sizes) < 0.2 * n


def days(n):
    return START.date() + timedelta(days=n)


def test_intervals_meet_their_points_by_bins(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), days(d), float(rng.randint(0, 9))) for d in range(300)]
    spans = [(k, rng.choice("abc"), days(s), days(s + rng.randint(-1, 150))) for k, s in enumerate(rng.sample(range(280), 60))]
    p = spark.createDataFrame(points, "name string, day date, v double")
    i = spark.createDataFrame(spans, "id int, name string, begin date, until date")
    got = {tuple(r) for r in tm.interval_join(i, p, ["name"], "begin", "until", "day", days=30).select("id", "day").collect()}
    assert got == {(k, d) for k, n, b, e in spans for m, d, _ in points if n == m and b <= d <= e}
    first = tm.first_within(i, p, ["name"], F.col("begin"), F.col("until"), "day", ["v"], lambda x: x["v"] <= 1, days=30)
    for row in first.collect():
        hits = [d for m, d, v in points if m == row.name and row.begin < d <= row.until and v <= 1]
        assert (row.first.day if row.first else None) == (min(hits) if hits else None)
    assert first.count() == len(spans)


def test_an_interval_makes_a_row_for_each_bin_it_touches(spark):
    points = spark.createDataFrame([("a", days(d), 1.0) for d in range(2000)], "name string, day date, v double")
    spans = spark.createDataFrame([("a", days(d), days(d + 40)) for d in range(0, 1900, 10)], "name string, begin date, until date")
    out = tm.first_within(spans, points, ["name"], F.col("begin"), F.col("until"), "day", ["v"], lambda x: x["v"] > 5, days=64)
    assert out.filter("first is not null").count() == 0
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_bin" in plan
