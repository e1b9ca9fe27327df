"""Registered queries: batch twins of the quote streams. Quotes are events; instruments are users or event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch, settle
from ..operators.portfolio import live_value, mark_to_market
from ..settings import DEFAULTS
from ..sources import panels
from ..streaming import quotes as live
from .common import cte, r, rnd, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


def user_quotes(spark, sf):
    """Quotes per user; every seventh has no price."""
    df = panels.table(spark, sf, "events")
    price = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return df.select(F.col("user_id").cast("string").alias("instrument"), "ts", price.alias("last_price"))


def previous_closes(spark, sf):
    """Last price before the final day; zero (unusable) for every eleventh user."""
    df = panels.table(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-30").cast("timestamp"))
    closes = df.groupBy(F.col("user_id").alias("u")).agg(F.max_by("value", "ts").alias("close"))
    return closes.select(F.col("u").cast("string").alias("instrument"), F.when(F.col("u") % 11 == 0, 0.0).otherwise(F.col("close")).alias("close"))


cte("user_quotes", "SELECT CAST(user_id AS VARCHAR) AS instrument, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS last_price FROM events")
cte("newest_quotes", "SELECT * FROM user_quotes QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) = 1")
cte(
    "changes",
    """SELECT instrument, ts, coalesce(last_price, prev) AS last_price, CASE WHEN prev > 0 THEN prev ELSE coalesce(last_price, prev) END AS previous_close,
CASE WHEN prev > 0 THEN coalesce(last_price, prev) - prev ELSE 0 END AS change, CASE WHEN prev > 0 THEN (coalesce(last_price, prev) - prev) / prev ELSE 0 END AS change_pct
FROM newest_quotes LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS instrument, CASE WHEN user_id % 11 = 0 THEN 0.0 ELSE max_by(value, ts) END AS prev FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY user_id) USING (instrument) WHERE coalesce(last_price, prev) IS NOT NULL""",
)


@register("STR1_latest_quote", f"SELECT instrument, ts, {r('last_price', 4)} FROM newest_quotes")
def _(spark, sf):
    return live.latest(user_quotes(spark, sf)).select("instrument", "ts", rnd("last_price", 4))


def changes(spark, sf):
    return live.with_change(live.latest(user_quotes(spark, sf)), previous_closes(spark, sf))


@register("STR2_change", f"SELECT instrument, {r('last_price', 4)}, {r('previous_close', 4)}, {r('change', 4)}, {r('change_pct', 6)} FROM changes")
def _(spark, sf):
    return changes(spark, sf).select("instrument", *[rnd(c, 4) for c in ("last_price", "previous_close", "change")], rnd("change_pct", 6))


@register(
    "STR3_quote_state",
    "SELECT instrument, CASE WHEN TIMESTAMP '2024-01-30 06:00:00' - ts > INTERVAL 60 SECOND THEN 'stale' WHEN last_price <> previous_close THEN 'live' ELSE 'previous_close' END AS state FROM changes",
)
def _(spark, sf):
    at = F.lit("2024-01-30 06:00:00").cast("timestamp")  # 11:30 on a trading day
    return changes(spark, sf).select("instrument", live.state(at).alias("state"))


@register(
    "STR4_day_range",
    f"SELECT instrument, CAST(ts AS DATE) AS day, {r('max(value)', 4, 'day_high')}, {r('min(value)', 4, 'day_low')}, count(*) AS volume FROM (SELECT event_type AS instrument, ts, value FROM events) GROUP BY 1, 2",
)
def _(spark, sf):
    df = live.day_range(panels.quotes(spark, sf))
    return df.select("instrument", F.to_date("day.start").alias("day"), rnd("day_high", 4), rnd("day_low", 4), "volume")


def quote_holdings(spark, sf):
    """Each user holds as many units of an event type as they have events of it."""
    events = panels.table(spark, sf, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("portfolio_id"), F.col("event_type").alias("instrument")).agg(F.count("*").alias("quantity"))


cte("hour_ticks", "SELECT event_type AS instrument, date_trunc('hour', ts) + INTERVAL 1 HOUR AS at_, max_by(value, ts) AS price FROM events GROUP BY 1, 2")
cte(
    "hour_prices",
    """SELECT instrument, at_, last_value(price IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS price
FROM (SELECT instrument, unnest(generate_series(min(at_), (SELECT max(at_) FROM hour_ticks), INTERVAL 1 HOUR)) AS at_ FROM hour_ticks GROUP BY 1) LEFT JOIN hour_ticks USING (instrument, at_)""",
)


@register(
    "STR5_portfolio_value",
    f"SELECT portfolio_id, at_ AS refreshed_at, {r('sum(quantity * price)', 4, 'value')} FROM (SELECT CAST(user_id AS VARCHAR) AS portfolio_id, event_type AS instrument, count(*) AS quantity FROM events GROUP BY 1, 2) JOIN hour_prices USING (instrument) GROUP BY 1, 2",
)
def _(spark, sf):
    df = live.value_by_refresh(panels.quotes(spark, sf), quote_holdings(spark, sf), "1 hour")
    return df.select("portfolio_id", F.col("at").alias("refreshed_at"), rnd("value", 4))


cte(
    "type_quotes",
    """SELECT event_type AS instrument, max_by(value, ts) AS price, max(ts) AS ts, max_by(value, ts) FILTER (ts < TIMESTAMP '2024-01-30') AS close,
(SELECT max(ts) FROM events) - max(ts) > INTERVAL 900 SECOND AS stale FROM events GROUP BY 1""",
)
cte(
    "marked_types",
    """SELECT portfolio_id, amount, CASE WHEN NOT stale AND q > 0 THEN q * price WHEN NOT stale AND close > 0 THEN amount / close * price ELSE amount END AS v, NOT stale AND (coalesce(q > 0, FALSE) OR coalesce(close > 0, FALSE)) AS fresh
FROM (SELECT CAST(user_id AS VARCHAR) AS portfolio_id, event_type AS instrument, count(*) * 10.0::DOUBLE AS amount, CASE WHEN user_id % 3 <> 0 THEN count(*) END AS q FROM events GROUP BY user_id, event_type) JOIN type_quotes USING (instrument)""",
)


CLOCK = "clock"


def arrived(spark, sf, key: str = "event_type", days: int = 8):
    """Quotes as a stream: a file for each eight days, arriving in order of time and read one by one with a watermark of an hour.

    The last file is a tick of the clock at the time of the last quote: timers see the watermark of the batches before, so
    without another arrival none would run for the last quotes.
    """
    quotes = panels.quotes(spark, sf, key).select("instrument", F.col("ts").cast("timestamp").alias("ts"), "last_price")
    path = scratch(spark)
    part = F.floor((F.dayofmonth("ts") - 1) / days)
    for k in range(-(-31 // days)):
        quotes.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    tick = quotes.agg(F.max("ts").alias("ts")).select(F.lit(CLOCK).alias("instrument"), "ts", F.lit(0.0).alias("last_price"))
    tick.write.mode("append").parquet(path)
    return live.read_stream(spark, path, live.SCHEMA, "1 hour", 1)


@register(
    "STR3_streamed_state",
    f"""SELECT instrument, ts, {r('last_price', 4)}, CASE WHEN ts + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'stale' ELSE 'live' END AS state
FROM (SELECT CAST(user_id AS VARCHAR) AS instrument, max(ts) AS ts, max_by(value, ts) AS last_price FROM events GROUP BY 1)""",
)
def _(spark, sf):
    """The stream itself, drained: states with event-time timers, a quote living for twelve hours."""
    states = live.expiring(arrived(spark, sf, "user_id"), DEFAULTS.with_(quote_ttl=12 * 3600))
    out = live.final_states(live.drain(states, scratch(spark), scratch(spark)))
    return out.filter(F.col("instrument") != CLOCK).select("instrument", F.col("ts").cast("timestamp_ntz").alias("ts"), rnd("last_price", 4), "state")


_refreshed = f"SELECT portfolio_id, {r('sum(amount)', 4, 'baseline')}, CASE WHEN bool_or(fresh) THEN round(sum(v), 4) END AS live_value, {r('CASE WHEN bool_or(fresh) THEN sum(v) - sum(amount) ELSE 0 END', 4, 'delta')} FROM marked_types GROUP BY 1"


@register("STR5_streamed_value", _refreshed)
def _(spark, sf):
    """The refreshing stream itself, drained: values of the last batch."""
    quotes = panels.quotes(spark, sf)
    as_of = F.lit(quotes.agg(F.max("ts")).first()[0])
    closes = quotes.filter(F.col("ts") < F.lit("2024-01-30").cast("timestamp")).groupBy("instrument").agg(F.max_by("last_price", "ts").alias("close"))
    held = settle(marked_holdings(spark, sf))  # read by every batch
    path = scratch(spark)
    query = live.refresh_portfolios(arrived(spark, sf), held, settle(closes), path, scratch(spark), once=True, as_of=as_of, cfg=DEFAULTS.with_(quote_ttl=900))
    query.awaitTermination()
    values = spark.read.parquet(path)
    newest = values.filter(F.col("batch_id") == values.agg(F.max("batch_id")).scalar())
    return newest.select("portfolio_id", rnd("baseline", 4), F.round("live_value", 4).alias("live_value"), rnd("delta", 4))


def marked_holdings(spark, sf):
    held = quote_holdings(spark, sf).withColumn("amount", F.col("quantity") * 10.0)
    return held.withColumn("quantity", F.when(F.col("portfolio_id").cast("long") % 3 != 0, F.col("quantity")))


@register(
    "STR5_refreshed_value",
    f"SELECT portfolio_id, {r('sum(amount)', 4, 'baseline')}, CASE WHEN bool_or(fresh) THEN round(sum(v), 4) END AS live_value, {r('CASE WHEN bool_or(fresh) THEN sum(v) - sum(amount) ELSE 0 END', 4, 'delta')} FROM marked_types GROUP BY 1",
)
def _(spark, sf):
    """One refresh, by the functions that the stream uses: quotes older than a quarter of an hour don't count."""
    quotes = panels.quotes(spark, sf)
    as_of = F.lit(quotes.agg(F.max("ts")).first()[0])
    now = live.with_staleness(live.latest(quotes), as_of, DEFAULTS.with_(quote_ttl=900))
    closes = quotes.filter(F.col("ts") < F.lit("2024-01-30").cast("timestamp")).groupBy("instrument").agg(F.max_by("last_price", "ts").alias("close"))
    held = marked_holdings(spark, sf)
    values = live_value(mark_to_market(held, now, closes))
    return values.select("portfolio_id", rnd("baseline", 4), F.round("live_value", 4).alias("live_value"), rnd("delta", 4))
