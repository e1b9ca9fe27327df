"""Window-frame helpers.

A panel holds at most one row per (key, calendar day), so every per-series window is
bounded by the length of the calendar, whatever share of the input rows a key owns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("instrument",)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key with all configured shuffle partitions.

    Series work is bound by CPU, not by bytes, so AQE must not merge its small partitions; later windows on
    the same key reuse this exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *(keys or KEYS))


def series(keys=KEYS, order="date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys=KEYS, order="date") -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return series(keys, order).rowsBetween(-(n - 1), 0)


def running(keys=KEYS, order="date") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def following(keys=KEYS, order="date") -> WindowSpec:
    return series(keys, order).rowsBetween(0, Window.unboundedFollowing)


def rolled(agg, col, n: int, keys=KEYS, least: int | None = None, order="date") -> Column:
    """`agg(col)` over n rows, NULL until `least` (default n) non-null values are in the frame."""
    frame = trailing(n, keys, order)
    return F.when(F.count(col).over(frame) >= (least or n), agg(col).over(frame))


def filled(col, limit: int | None = None, keys=KEYS, order="date") -> Column:
    """Forward fill, reaching back at most `limit` rows."""
    w = series(keys, order)
    low = Window.unboundedPreceding if limit is None else -limit
    return F.last(col, ignorenulls=True).over(w.rowsBetween(low, 0))


def ratio(num, den) -> Column:
    """num / den with NULL instead of a division by zero."""
    return num / F.nullif(den, F.lit(0.0))


def change(col, n: int = 1, keys=KEYS, order="date") -> Column:
    """col / col n rows earlier - 1."""
    return ratio(col, F.lag(col, n).over(series(keys, order))) - 1


def clip(col, low, high) -> Column:
    """NULL-preserving clamp."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)


def tanh(col) -> Column:
    return F.tanh(col)
