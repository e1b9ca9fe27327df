"""Joins in time: the last row before an instant, and rows inside intervals, split by slices of the calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Left rows of one key and slice that a task takes; more are dealt into parts.
PART_ROWS = 500_000


def slice_of(time: Column, days: int) -> Column:
    """Number of the calendar slice that a date or timestamp falls in."""
    return F.floor(F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")) / days).cast("int")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], slice_days: int = 30, part_rows: int = PART_ROWS
) -> DataFrame:
    """`left` with `values` of the last `right` row of its keys at or before its `time`; NULL without one.

    Of several right rows at one instant the one with the greatest values is taken. Keys and times that are NULL match nothing, and every left
    row comes back once.

    Time is cut into slices. A slice's last right row is carried over to the later slices in a table of one row for each key and
    slice; the carried row then enters its slice as the earliest one, so that a slice is worked out alone, by one running window.
    A key that owns most rows is thereby spread over the calendar, and a slice with over `part_rows` left rows (an instant
    with a large share of all rows) is dealt into parts that each hold the slice's right rows, at most one an instant.
    """
    keys, values = list(keys), list(values)
    hit_type = "struct<" + ",".join(f"`{c}`:{right.schema[c].dataType.simpleString()}" for c in (time, *values)) + ">"
    known = F.lit(True)
    for c in (*keys, time):
        known = known & F.col(c).isNotNull()
    at = slice_of(F.col(time), slice_days)
    found = right.filter(known).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).select(
        *keys, at.alias("_slice"), F.col(time).alias("_t"), F.struct(F.col(time), *[F.col(f"_v.{c}") for c in values]).cast(hit_type).alias("_hit")
    )
    asked = left.select(*[F.col(c) for c in keys], F.when(known, at).alias("_slice"), F.col(time).alias("_t"), F.struct(*left.columns).alias("_row"))

    counts = found.groupBy(*keys, "_slice").agg(F.max("_hit").alias("_hit"), F.lit(0).cast("long").alias("_n")).unionByName(
        asked.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).withColumn("_hit", F.lit(None).cast(hit_type))
    )
    marks = counts.groupBy(*keys, "_slice").agg(F.max("_hit").alias("_hit"), F.sum("_n").alias("_n"))
    past = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_slice", F.last("_hit", ignorenulls=True).over(past).alias("_hit")).filter("_hit is not null")
    # at most one for every `part_rows` left rows
    hot = marks.filter(F.col("_n") > part_rows).select(*keys, "_slice", F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))

    earlier = carried.select(*keys, "_slice", F.lit(None).cast(found.schema["_t"].dataType).alias("_t"), "_hit").unionByName(found)
    earlier = earlier.join(F.broadcast(hot), [*keys, "_slice"], "left")
    earlier = earlier.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    asked = asked.join(F.broadcast(hot), [*keys, "_slice"], "left")
    dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    asked = asked.withColumn("_part", dealt).drop("_parts")
    both = earlier.withColumns({"_side": F.lit(0), "_row": F.lit(None).cast(asked.schema["_row"].dataType)}).unionByName(
        asked.withColumns({"_side": F.lit(1), "_hit": F.lit(None).cast(hit_type)})
    )
    w = Window.partitionBy(*keys, "_slice", "_part").orderBy(F.col("_t").asc_nulls_first(), "_side")
    hit = F.when(F.col("_slice").isNotNull(), F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_last", hit).filter("_side = 1")
    return both.select("_row.*", F.col(f"_last.{time}").alias(f"{time}_found"), *[F.col(f"_last.{c}").alias(c) for c in values])


def binned(points: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], days: int) -> DataFrame:
    """One row for each key and calendar bin: `points`, its rows in order of time. For panels, whose rows are at most one a day."""
    rows = F.sort_array(F.collect_list(F.struct(time, *values))).alias("points")
    return points.groupBy(*keys, slice_of(F.col(time), days).alias("_bin")).agg(rows)


def first_within(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: Column, end: Column, time: str, values: Sequence[str], hit, days: int = 64
) -> DataFrame:
    """`intervals` with `first`: the first point (time and values) after `start`, not after `end`, for which hit(point) is true.

    An interval meets its points bin by bin, by equality of keys and bin: as many rows as it touches bins, whatever share of the
    points its key has. Within a bin only the points inside the interval are looked at. No point, or a NULL end, gives NULL.
    """
    keys = list(keys)
    rows = intervals.withColumns({"_from": start, "_to": end, "_id": F.monotonically_increasing_id()})
    touched = F.when(F.col("_to") >= F.col("_from"), F.sequence(slice_of(F.col("_from"), days), slice_of(F.col("_to"), days)))
    asked = rows.withColumn("_bin", F.explode_outer(touched))
    joined = asked.join(binned(points, keys, time, values, days), [*keys, "_bin"], "left")
    inside = F.filter("points", lambda p: (p[time] > F.col("_from")) & (p[time] <= F.col("_to")) & hit(p))
    joined = joined.withColumn("_first", F.get(inside, F.lit(0)))
    given = [F.first(F.struct(*intervals.columns)).alias("_row"), F.min("_first").alias("first")]
    return joined.groupBy("_id").agg(*given).select("_row.*", "first")


def interval_join(
    intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, time: str, days: int = 64
) -> DataFrame:
    """Every interval with each point of its keys from `start` to `end`, both included; column names of the two differ but for the keys.

    Both sides meet by equality of keys and calendar bin, so no point is compared with an interval that touches none of its days.
    """
    bins = F.sequence(slice_of(F.col(start), days), slice_of(F.col(end), days))
    asked = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(bins))
    met = asked.join(points.withColumn("_bin", slice_of(F.col(time), days)), [*keys, "_bin"])
    return met.filter((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bin")
