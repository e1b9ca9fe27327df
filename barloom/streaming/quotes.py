"""Live quotes. Every function takes a batch or a streaming DataFrame unless it says otherwise, so that each
streaming result has a batch twin to be checked against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.frames import filled, ratio
from ..functions.skew import salted_join
from ..operators.portfolio import live_value, mark_to_market
from ..settings import DEFAULTS, Settings
from ..sources.calendar import is_session_open, local_time

SCHEMA = "instrument string, ts timestamp, last_price double"
HOLDERS = 256  # holders of an instrument that a task values at every refresh


def read_stream(spark: SparkSession, path: str, schema: str, late: str = "1 hour", per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under `path`, with a watermark on ts: rows later than `late` are dropped."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withWatermark("ts", late)


def latest(quotes: DataFrame) -> DataFrame:
    """Newest quote per instrument. A hot instrument is reduced map-side; its state is one row."""
    return quotes.groupBy("instrument").agg(
        F.max("ts").alias("ts"), F.max_by("last_price", "ts").alias("last_price")
    )


def with_change(newest: DataFrame, closes: DataFrame) -> DataFrame:
    """Change against the previous close. Without a last price the previous close stands in; without a usable
    previous close there is no change."""
    df = newest.join(closes.select("instrument", F.col("close").alias("_prev")), "instrument", "left")
    last = F.coalesce("last_price", "_prev")
    good = F.col("_prev") > 0
    df = df.withColumns(
        {
            "last_price": last,
            "previous_close": F.when(good, F.col("_prev")).otherwise(last),
            "change": F.when(good, last - F.col("_prev")).otherwise(0.0),
            "change_pct": F.when(good, ratio(last - F.col("_prev"), F.col("_prev"))).otherwise(0.0),
        }
    )
    return df.filter(F.col("last_price").isNotNull()).drop("_prev")


def state(as_of: Column, cfg: Settings = DEFAULTS) -> Column:
    """live / previous_close / stale of a row with ts, last_price and previous_close.

    A price equal to the previous close reads as not live.
    """
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    moving = is_session_open(local_time(as_of)) & (F.col("last_price") != F.col("previous_close"))
    return F.when(age > cfg.quote_ttl * 1_000_000, "stale").when(moving, "live").otherwise("previous_close")


def day_range(quotes: DataFrame) -> DataFrame:
    """High, low and number of quotes so far per instrument and day."""
    return quotes.groupBy("instrument", F.window("ts", "1 day").alias("day")).agg(
        F.max("last_price").alias("day_high"), F.min("last_price").alias("day_low"), F.count("*").alias("volume")
    )


def with_staleness(newest: DataFrame, as_of: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """`stale`: no price, or a quote older than the time to live at `as_of`."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return newest.withColumn("stale", F.col("last_price").isNull() | F.col("ts").isNull() | (age > cfg.quote_ttl * 1_000_000))


def value_by_refresh(quotes: DataFrame, holdings: DataFrame, every: str = "1 minute") -> DataFrame:
    """Batch: portfolio value at each refresh, each instrument at its newest price so far.

    Prices meet holdings in a join that cuts an instrument held by many portfolios into parts.
    """
    ticks = quotes.groupBy("instrument", F.window("ts", every)["end"].alias("at")).agg(
        F.max_by("last_price", "ts").alias("price")
    )
    # Last price per refresh; a refresh an instrument missed repeats the one before. The axis of refreshes is a
    # sequence between an instrument's first tick and the last one overall.
    end = ticks.agg(F.max("at")).scalar()
    names = ticks.groupBy("instrument").agg(F.min("at").alias("since"))
    grid = names.select("instrument", F.explode(F.sequence("since", end, F.expr(f"INTERVAL {every}"))).alias("at"))
    prices = grid.join(ticks, ["instrument", "at"], "left")
    prices = prices.withColumn("price", filled("price", None, ("instrument",), "at"))
    return (
        salted_join(holdings, prices, "instrument", "portfolio_id", HOLDERS)
        .groupBy("portfolio_id", "at")
        .agg(F.sum(F.col("quantity") * F.col("price")).alias("value"))
    )


# ---- streaming only ----


def expiring(quotes: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Streaming: one row per instrument whenever its state turns `live` (a quote came) or `stale` (none came for
    the time to live, in event time). State is the newest quote; a timer closes it."""
    ttl = cfg.quote_ttl * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            ts, price = held.get
            held.remove()
            yield _row(key[0], ts, price, "stale")
            return
        ts, price = held.get if held.exists else (0, None)
        for b in batches:
            at = int(b["ts"].to_numpy().argmax())
            seen = b["ts"].iloc[at].value // 1000
            if seen >= ts:
                ts, price = seen, float(b["last_price"].iloc[at])
        held.update((ts, price))
        held.setTimeoutTimestamp(max(ts // 1000, held.getCurrentWatermarkMs()) + ttl)
        yield _row(key[0], ts, price, "live")

    def _row(name, ts, price, what):
        return pd.DataFrame({"instrument": [name], "ts": [pd.Timestamp(ts, unit="us")], "last_price": [price], "state": [what]})

    return quotes.groupBy("instrument").applyInPandasWithState(
        step,
        SCHEMA + ", state string",
        "ts long, last_price double",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Streaming: run over everything that has arrived, write each batch under batch_id=<n>, and return the table of all batches.

    A repeated batch overwrites its own folder, so that a restart from `checkpoint` leaves each row once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema, T.StructField("batch_id", T.LongType())])).parquet(path)


def final_states(states: DataFrame) -> DataFrame:
    """The last state of each instrument out of the drained rows of `expiring`."""
    return states.groupBy("instrument").agg(*[F.max_by(c, "batch_id").alias(c) for c in ("ts", "last_price", "state")])


def refresh_portfolios(quotes: DataFrame, holdings: DataFrame, closes: DataFrame, path: str, checkpoint: str, every: str = "1 minute", once: bool = False, as_of: Column | None = None, cfg: Settings = DEFAULTS) -> StreamingQuery:
    """Streaming: on every trigger value all portfolios at the newest quotes and write them under batch_id=<n>.

    A quote older than the time to live at the trigger (or at `as_of`) counts as stale.

    The stream keeps one row per instrument. A repeated batch overwrites its own folder, so a restart after a
    lost executor or driver leaves each batch once.
    """

    def write(newest: DataFrame, batch_id: int) -> None:
        quotes_now = with_staleness(newest, F.current_timestamp() if as_of is None else as_of, cfg)
        values = live_value(mark_to_market(holdings, quotes_now, closes))
        values.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = latest(quotes).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.foreachBatch(write).start()
