"""Trading-calendar expressions. The holiday list is a small literal, so nothing here joins or shuffles."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dimensions import HOLIDAYS

OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 15, 15 * 60 + 30  # Fixed values: session 09:15 to 15:30.
UTC_OFFSET_MINUTES = 330  # Fixed value: UTC+5:30.


def _longest_closure() -> int:
    """Most consecutive closed days that weekends and the holiday list can produce."""
    closed = {date.fromisoformat(d) for d in HOLIDAYS}
    best = 2
    for day in closed:
        lo = hi = day
        while lo - timedelta(1) in closed or (lo - timedelta(1)).weekday() >= 5:
            lo -= timedelta(1)
        while hi + timedelta(1) in closed or (hi + timedelta(1)).weekday() >= 5:
            hi += timedelta(1)
        best = max(best, (hi - lo).days + 1)
    return best


LONGEST_CLOSURE = _longest_closure()


def local_time(ts: Column) -> Column:
    """UTC instant -> zone-free exchange wall clock."""
    return (ts + F.expr(f"INTERVAL '{UTC_OFFSET_MINUTES}' MINUTE")).cast("timestamp_ntz")


def holiday_name(day: Column) -> Column:
    pairs = [F.lit(x) for d, name in HOLIDAYS.items() for x in (d, name)]
    return F.create_map(*pairs)[day.cast("string")]


def is_trading_day(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7) & ~day.cast("string").isin(list(HOLIDAYS))


def _minute(local: Column) -> Column:
    return (F.hour(local) * 60 + F.minute(local)) * 60 + F.second(local)


def is_session_open(local: Column) -> Column:
    """Both ends of the session are inclusive: 15:30:00 is open, any later instant is not."""
    at = _minute(local)
    exact_close = (at == CLOSE_MINUTE * 60) & (local == F.date_trunc("second", local).cast("timestamp_ntz"))
    in_hours = (at >= OPEN_MINUTE * 60) & ((at < CLOSE_MINUTE * 60) | exact_close)
    return is_trading_day(F.to_date(local)) & in_hours


def last_trading_day(local: Column) -> Column:
    """Newest trading day at or before `local`; before the open the day itself does not count yet."""
    day = F.to_date(local)
    start = F.when(is_trading_day(day) & (_minute(local) < OPEN_MINUTE * 60), F.date_sub(day, 1)).otherwise(day)
    back = F.sequence(F.date_sub(start, LONGEST_CLOSURE), start)
    return F.array_max(F.filter(back, is_trading_day))


def market_status(local: Column) -> Column:
    day = F.to_date(local)
    name = holiday_name(day)
    return (
        F.when(is_session_open(local), "MARKETS OPEN")
        .when(name.isNotNull(), F.concat(F.lit("MARKETS CLOSED — "), name))
        .when(F.dayofweek(day).isin(1, 7), "WEEKEND — MARKETS CLOSED")
        .otherwise("AFTER HOURS — MARKETS CLOSED")
    )


def master_calendar(panel: DataFrame) -> DataFrame:
    """Every date on which any instrument has a bar."""
    return panel.select("date").distinct()
