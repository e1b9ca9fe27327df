"""Registered queries: sources, calendar and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..operators import quality
from ..operators.returns import fill_short_gaps
from ..operators.temporal import asof_join
from ..sources import bars as store
from ..sources import calendar as cal
from ..sources import dimensions as dim
from ..sources import panels
from . import price_sql  # noqa: F401
from .common import big, cte, r, rnd, sql
from .price_sql import PART

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BAR = ("instrument", "date", "open", "high", "low", "close", "volume")
BAR_SQL = ", ".join(BAR)


def register(name, oracle=None):
    def keep(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return run

    return keep


cte(
    "funded",
    "SELECT CAST(s_suppkey AS VARCHAR) AS instrument FROM supplier WHERE s_acctbal > 0",
)


def funded(spark, sf):
    return panels.table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("instrument")
    )


IN_RANGE = f"SELECT {BAR_SQL} FROM bars WHERE instrument IN (SELECT instrument FROM funded) AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"


@register("SRC1_scan_universe_and_range", IN_RANGE)
def _(spark, sf):
    return store.select_bars(panels.daily_bars(spark, sf), funded(spark, sf), "1996-01-01", "2000-12-31")


@register("SRC2_written_and_scanned", IN_RANGE)
def _(spark, sf):
    """The bars written to the shared folder and scanned from there: the date filter reaches the files."""
    path = scratch(spark)
    store.write_bars(panels.daily_bars(spark, sf), path)
    return store.scan_bars(spark, path, universe=funded(spark, sf), start="1996-01-01", end="2000-12-31")


_fixed = "date BETWEEN DATE '1998-03-02' AND DATE '1998-03-20' AND CAST(instrument AS BIGINT) % 3 = 1"


@register(
    "SRC2_upserted",
    f"""SELECT instrument, date, open, high, low, CASE WHEN {_fixed} THEN round(close * 1.01, 4) ELSE close END AS close,
CASE WHEN {_fixed} THEN volume + 1 ELSE volume END AS volume FROM bars""",
)
def _(spark, sf):
    """A table without the bars since 1998-03-10 (a part of a year) takes them, and corrections of some days before, in two merges."""
    path = scratch(spark)
    bars = panels.daily_bars(spark, sf)
    late = F.col("date") >= F.lit("1998-03-10").cast("date")
    store.write_bars(bars.filter(~late), path)
    store.upsert_bars(bars.filter(late), path)
    corrected = bars.filter(F.expr(_fixed)).withColumns({"close": F.round(F.col("close") * 1.01, 4), "volume": F.col("volume") + 1})
    store.upsert_bars(corrected, path)
    return store.scan_bars(spark, path).select(*BAR)


@register(
    "SRC2_freshness",
    "SELECT instrument, max(date) AS newest, max(date) < DATE '2001-11-02' AS stale FROM bars GROUP BY instrument",
)
def _(spark, sf):
    as_of = F.lit("2001-11-04 12:00:00").cast("timestamp_ntz")  # a Sunday, the last day of the panel
    return store.freshness(panels.daily_bars(spark, sf), as_of)


@register(
    "SRC3_benchmark_series",
    f"SELECT {BAR_SQL}, {r('Daily_Return', 8)}, {r('Adj_Return', 8)} FROM b_ret",
)
def _(spark, sf):
    series = store.load_series(panels.benchmark_bars(spark, sf), "MARKET")
    return series.select(*BAR, rnd("Daily_Return", 8), rnd("Adj_Return", 8))


@register(
    "SRC4_zone_free_time",
    "SELECT event_id, ts + INTERVAL 330 MINUTE AS local_ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_date FROM events",
)
def _(spark, sf):
    local = cal.local_time(F.col("ts"))
    return panels.table(spark, sf, "events").select(
        "event_id", local.alias("local_ts"), F.to_date(local).alias("local_date")
    )


@register(
    "SRC6_extend_universe",
    f"SELECT {BAR_SQL} FROM bars WHERE instrument NOT IN (SELECT instrument FROM funded) UNION ALL "
    "SELECT instrument, date, open * 2, high * 2, low * 2, close * 2, volume FROM bars WHERE instrument IN (SELECT instrument FROM funded)",
)
def _(spark, sf):
    bars = panels.daily_bars(spark, sf)
    extra = store.select_bars(bars, funded(spark, sf))
    return store.extend(bars, extra.withColumns({c: F.col(c) * 2 for c in ("open", "high", "low", "close")}))


@register(
    "SRC7_reconcile_requests",
    "SELECT instrument, instrument IN (SELECT instrument FROM bars) AS loaded FROM "
    "(SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS instrument FROM customer)",
)
def _(spark, sf):
    asked = panels.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("instrument"))
    return store.reconcile(asked, panels.daily_bars(spark, sf))


# ---- calendar: every event's time, and every date of the panel and the events ----

_names = " ".join(f"WHEN DATE '{d}' THEN '{n}'" for d, n in dim.HOLIDAYS.items())
_closed = ", ".join(f"DATE '{d}'" for d in dim.HOLIDAYS)
cte("moments", "SELECT event_id, ts + INTERVAL 330 MINUTE AS t, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS d FROM events")
cte(
    "known_days",
    "SELECT DISTINCT date FROM (SELECT d AS date FROM moments UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem)",
)


def _trading(d: str) -> str:
    return f"(isodow({d}) < 6 AND {d} NOT IN ({_closed}))"


_open = f"({_trading('d')} AND CAST(t AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00')"


def _moments(spark, sf):
    return panels.table(spark, sf, "events").select("event_id", cal.local_time(F.col("ts")).alias("t"))


def _days(spark, sf):
    moments = _moments(spark, sf).select(F.to_date("t").alias("date"))
    ships = panels.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return cal.master_calendar(moments.unionByName(ships))


@register("CAL1_trading_day", f"SELECT date, {_trading('date')} AS trading FROM known_days")
def _(spark, sf):
    return _days(spark, sf).select("date", cal.is_trading_day(F.col("date")).alias("trading"))


@register("CAL2_session_open", f"SELECT event_id, {_open} AS is_open FROM moments")
def _(spark, sf):
    return _moments(spark, sf).select("event_id", cal.is_session_open(F.col("t")).alias("is_open"))


@register(
    "CAL3_last_trading_day",
    f"""SELECT event_id, (SELECT max(x) FROM (SELECT s - CAST(i AS INT) AS x FROM range(0, 15) g(i)) WHERE {_trading('x')}) AS trading_date
FROM (SELECT event_id, CASE WHEN {_trading('d')} AND CAST(t AS TIME) < TIME '09:15:00' THEN d - 1 ELSE d END AS s FROM moments)""",
)
def _(spark, sf):
    return _moments(spark, sf).select("event_id", cal.last_trading_day(F.col("t")).alias("trading_date"))


cte(
    "bought",
    "SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_suppkey AS VARCHAR) AS instrument, CAST(o_orderdate AS DATE) AS date "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)


@register(
    "CAL3_last_bar_of_order_lines",
    """SELECT b.l_orderkey, b.l_linenumber, b.l_quantity, b.instrument, b.date, bars.date AS date_found, bars.close, bars.volume
FROM bought b ASOF LEFT JOIN bars ON b.instrument = bars.instrument AND b.date >= bars.date""",
)
def _(spark, sf):
    """The last bar of each line's supplier on the order's day or before."""
    orders = panels.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    lines = panels.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_suppkey").cast("string").alias("instrument"), "date")
    return asof_join(lines, panels.daily_bars(spark, sf), ["instrument"], "date", ["close", "volume"])


@register(
    "PERF11_last_quote_before_events",
    """SELECT a.event_id, a.event_type, a.ts, b.ts AS ts_found, b.last_price
FROM events a ASOF LEFT JOIN (SELECT event_type, ts, max(value) AS last_price FROM events WHERE event_id % 3 = 0 GROUP BY ALL) b
ON a.event_type = b.event_type AND a.ts >= b.ts""",
)
def _(spark, sf):
    """Every third event is a quote; each event gets the last quote of its type: few keys, each with a large share of all rows."""
    events = panels.table(spark, sf, "events")
    quotes = events.filter("event_id % 3 = 0").select("event_type", "ts", F.col("value").alias("last_price"))
    return asof_join(events.select("event_id", "event_type", "ts"), quotes, ["event_type"], "ts", ["last_price"], slice_days=1)


@register(
    "CAL4_market_status",
    f"""SELECT event_id, CASE WHEN {_open} THEN 'MARKETS OPEN' WHEN d IN ({_closed}) THEN 'MARKETS CLOSED — ' || CASE d {_names} END
WHEN isodow(d) > 5 THEN 'WEEKEND — MARKETS CLOSED' ELSE 'AFTER HOURS — MARKETS CLOSED' END AS status FROM moments""",
)
def _(spark, sf):
    return _moments(spark, sf).select("event_id", cal.market_status(F.col("t")).alias("status"))


@register("CAL5_holiday_name", f"SELECT date, CASE date {_names} END AS holiday FROM known_days")
def _(spark, sf):
    return _days(spark, sf).join(F.broadcast(dim.holidays(spark)), "date", "left")


@register("CAL6_master_calendar", "SELECT DISTINCT date FROM bars")
def _(spark, sf):
    return cal.master_calendar(panels.daily_bars(spark, sf))


# ---- data quality on the panel with planted defects ----

_gone = " OR ".join(
    f"last_value({c} IGNORE NULLS) OVER ({PART} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) IS NULL"
    for c in ("open", "high", "low", "close", "volume")
)
cte(
    "dq",
    f"""SELECT instrument, count(*) AS rows_, avg(CAST(gone AS INT)) AS missing_pct, count(*) FILTER (close <= 0) AS bad,
count(*) FILTER (abs(padded / nullif(before, 0) - 1) > 0.5) AS moves
FROM (SELECT *, lag(padded) OVER ({PART}) AS before FROM (SELECT *, {_gone} AS gone,
  last_value(close IGNORE NULLS) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS padded FROM defective)) GROUP BY instrument""",
)
cte(
    "dq_report",
    """SELECT *, reason = '' AS passed, CASE WHEN reason = '' THEN moves ELSE 0 END AS extreme_moves FROM (SELECT *, CASE WHEN rows_ < 100 THEN printf('too few rows (%d < 100)', rows_)
WHEN missing_pct > 0.12 THEN printf('missing pct %.1f%% > 12.0%%', missing_pct * 100) WHEN bad > 0 THEN printf('%d zero/negative close prices', bad) ELSE '' END AS reason FROM dq)""",
)


def _checks(spark, sf):
    return quality.checks(panels.defective_bars(spark, sf))


@register("DQ1_row_count", "SELECT instrument, rows_ AS rows, rows_ >= 100 AS passed FROM dq")
def _(spark, sf):
    return _checks(spark, sf).select("instrument", "rows", (F.col("rows") >= 100).alias("passed"))


@register("DQ2_missing_fraction", f"SELECT instrument, {r('missing_pct', 8)}, missing_pct <= 0.12 AS passed FROM dq")
def _(spark, sf):
    return _checks(spark, sf).select("instrument", rnd("missing_pct", 8), (F.col("missing_pct") <= 0.12).alias("passed"))


@register("DQ3_bad_prices", "SELECT instrument, bad AS zero_or_neg_prices, bad = 0 AS passed FROM dq")
def _(spark, sf):
    return _checks(spark, sf).select(
        "instrument", "zero_or_neg_prices", (F.col("zero_or_neg_prices") == 0).alias("passed")
    )


@register("DQ4_extreme_moves", "SELECT instrument, moves FROM dq")
def _(spark, sf):
    return _checks(spark, sf).select("instrument", "moves")


@register(
    "DQ5_quality_report",
    f"SELECT instrument, rows_ AS rows, {r('missing_pct', 8)}, bad AS zero_or_neg_prices, CAST(extreme_moves AS BIGINT) AS extreme_moves, passed, reason FROM dq_report",
)
def _(spark, sf):
    return quality.report(panels.defective_bars(spark, sf)).select(
        "instrument", "rows", rnd("missing_pct", 8), "zero_or_neg_prices", big("extreme_moves"), "passed", "reason"
    )


@register("DQ6_gated_universe", f"SELECT {BAR_SQL} FROM defective WHERE instrument IN (SELECT instrument FROM dq_report WHERE passed)")
def _(spark, sf):
    return quality.gate(panels.defective_bars(spark, sf)).select(*BAR)


@register("DQ7_fill_short_gaps", f"SELECT {BAR_SQL} FROM patched")
def _(spark, sf):
    return fill_short_gaps(panels.defective_bars(spark, sf)).select(*BAR)
