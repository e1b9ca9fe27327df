"""Trade outcomes as set operations over signals, and trade-log statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, clip, series
from ..settings import DEFAULTS, Settings
from .ideas import short_eligible
from .temporal import first_within

NEEDED = ("close", "high", "low", "ATR_14", "Return_20d", "Confidence", "RSI_14", "Regime_Label", "Signal")
BAR = ("low", "high", "close", "Signal")
LEAST_ROWS = 60


def complete(df: DataFrame, columns) -> Column:
    """Whether no value of the row is missing, as `dropna` tests it: neither NULL nor NaN."""
    test, types = F.lit(True), dict(df.dtypes)
    for c in columns:
        test = test & F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            test = test & ~F.isnan(c)
    return test


def candidate_exits(signals: DataFrame, cfg: Settings = DEFAULTS, stop=2.0, target=4.0, keys=KEYS) -> DataFrame:
    """First exit of every eligible entry: (keys, i, j, entry_date, exit_date, reason, ret).

    i and j number the complete bars of the key inside the look-back. A key's bars (at most one a day) are one array of the few
    columns needed; an eligible entry looks at the `max_hold` bars after it, all entries of many keys a bar at a time.
    """
    rows = signals.select(
        *keys,
        "date",
        *BAR,
        (F.col("close") - stop * F.col("ATR_14")).alias("stop"),
        (F.col("close") + target * F.col("ATR_14")).alias("target"),
        (short_eligible(cfg) & (F.col("ATR_14") > 0)).alias("eligible"),
        complete(signals, NEEDED).alias("_complete"),
    )
    # Incomplete bars are left out here: a filter on them would be pushed below the columns it names and repeat all that they
    # are made of in one method, too large for the JVM to compile.
    item = F.when(F.col("_complete"), F.struct("date", *BAR, "stop", "target", "eligible"))
    bars = F.sort_array(F.collect_list(item))  # at most one a day
    packed = rows.groupBy(*keys).agg(bars.alias("_bars")).filter(F.size("_bars") >= LEAST_ROWS)
    kept = cfg.lookback + cfg.max_hold
    packed = packed.select(*keys, F.slice("_bars", F.greatest(F.size("_bars") - kept, F.lit(0)) + 1, kept).alias("_bars"))
    types = {f.name: f.dataType.simpleString() for f in packed.schema}

    def run(batches):
        for batch in batches:
            owner, found = first_exits(batch.column("_bars"), cfg.max_hold)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(owner) for c in keys], *found.values()], [*keys, *found])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", i int, j int, entry_date date, exit_date date, reason string, ret double"
    return packed.mapInArrow(run, schema)


def first_exits(bars: pa.Array, hold: int) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Of lists of bars: the list of each eligible entry that has a bar ahead, and its first exit."""
    inner, size = bars.flatten(), bars.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    low, high, close, signal, down, up, eligible = (inner.field(c).to_numpy(zero_copy_only=False) for c in (*BAR, "stop", "target", "eligible"))
    end = np.cumsum(size)
    begin, owner = end - size, np.repeat(np.arange(len(size)), size)
    entry = np.flatnonzero(eligible.astype(bool))
    entry = entry[entry + 1 < end[owner[entry]]]  # the newest bar has none ahead
    key, at = owner[entry], np.minimum(entry + hold, end[owner[entry]] - 1)  # without another exit the last bar of the hold
    left = np.arange(len(entry))
    for k in range(1, hold + 1):
        left = left[entry[left] + k <= at[left]]
        bar, own = entry[left] + k, entry[left]
        out = ~(low[bar] > down[own]) | (high[bar] >= up[own]) | (signal[bar] == -1)
        at[left[out]] = bar[out]
        left = left[~out]
    stopped, reached, sold = ~(low[at] > down[entry]), high[at] >= up[entry], signal[at] == -1
    reason = np.select([stopped, reached, sold], ["stop", "target", "signal"], "time")
    price = np.where(stopped, down[entry], np.where(reached, up[entry], close[at]))
    free = close[entry] == 0
    date = inner.field("date")
    return pa.array(key), {
        "i": pa.array(entry - begin[key], pa.int32()),
        "j": pa.array(at - begin[key], pa.int32()),
        "entry_date": date.take(pa.array(entry)),
        "exit_date": date.take(pa.array(at)),
        "reason": pa.array(reason.astype(object), pa.string()),
        "ret": pa.array(price / np.where(free, 1.0, close[entry]) - 1, pa.float64(), mask=free),
    }


def without_overlap(candidates: DataFrame, keys=KEYS) -> DataFrame:
    """Per key the first candidate, then the first one after its exit, and so on.

    A key has at most one candidate per bar of the look-back, so its array is short.
    """
    fields = [c for c in candidates.columns if c not in keys]
    item = F.struct("i", *[c for c in fields if c != "i"])
    grouped = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    # Candidates are ordered by i: keep one whose i lies beyond the exit of the last one kept.
    free = F.struct(F.lit(-1).alias("until"), F.slice("all", 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(x["j"].cast("int").alias("until"), F.array_append(acc["kept"], x).alias("kept"))
        return F.when(x["i"] > acc["until"], taken).otherwise(acc)

    chosen = F.aggregate("all", free, step, lambda acc: acc["kept"])
    return grouped.select(*keys, F.explode(chosen).alias("t")).select(*keys, "t.*")


def net_of_costs(trades: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Return after a cost on each side, and bars held."""
    return trades.withColumn("ret", F.col("ret") - 2 * cfg.cost).withColumn("hold", F.col("j") - F.col("i"))


def track_record(signals: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    return net_of_costs(without_overlap(candidate_exits(signals, cfg, keys=keys), keys), cfg)


def profit_factor(value: str) -> Column:
    """Wins over losses; infinite without a loss, 0 without a win."""
    wins = F.sum(F.when(F.col(value) > 0, F.col(value)))
    losses = F.sum(F.when(F.col(value) <= 0, F.col(value)))
    return (
        F.when(losses < 0, F.coalesce(wins, F.lit(0.0)) / F.abs(losses))
        .when(wins.isNotNull(), F.lit(float("inf")))
        .otherwise(0.0)
    )


def _mean_or_zero(cond: Column, value: str) -> Column:
    return F.coalesce(F.avg(F.when(cond, F.col(value))), F.lit(0.0))


def record_stats(trades: DataFrame, by=()) -> DataFrame:
    """Signal-quality statistics of a track record, optionally per group."""
    win = F.col("ret") > 0
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(win.cast("int")).alias("win_rate"),
        F.avg("ret").alias("avg_return"),
        _mean_or_zero(win, "ret").alias("avg_win"),
        _mean_or_zero(~win, "ret").alias("avg_loss"),
        profit_factor("ret").alias("profit_factor"),
        F.avg("hold").alias("avg_hold_days"),
        F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
        *[F.count_if(F.col("reason") == k).alias(f"n_{k}") for k in ("stop", "target", "signal", "time")],
    )


# ---- entries, sizes and exits of a trade log ----


def buy_candidates(signals: DataFrame, cfg: Settings = DEFAULTS, scope=()) -> DataFrame:
    """Per day the most confident BUYs, as many as there are slots (`slot` = 1, 2, …)."""
    buys = signals.filter((F.col("Signal") == 1) & (F.col("Confidence") > 0) & (F.col("close") > 0))
    order = Window.partitionBy(*scope, "date").orderBy(F.col("Confidence").desc(), "instrument")
    # A filter on row_number lets Spark keep only the top rows of each task before the shuffle.
    return buys.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= cfg.slots)


def size_fraction(cfg: Settings = DEFAULTS) -> Column:
    """Share of net asset value for an entry."""
    sure, size = clip(F.col("Confidence"), 0.0, 1.0), clip(F.col("Size_Mult"), 0.0, 1.0)
    return F.least(cfg.position_cap * size * (0.5 + 0.5 * sure), F.lit(cfg.position_cap))


def with_next_exit(signals: DataFrame, scope=()) -> DataFrame:
    """Add `next_sell` (date and close of the next SELL bar) and `last_bar` to every signal row.

    Reversed time turns "next" into a running last value, so the series is scanned once.
    """
    newest_first = Window.partitionBy(*scope, "instrument").orderBy(F.col("date").desc())
    bar = F.struct("date", "close")
    sell = F.when((F.col("Signal") == -1) & F.col("close").isNotNull(), bar)
    return signals.withColumns(
        {
            "next_sell": F.last(sell, ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, -1)),
            "last_bar": F.first(bar).over(newest_first.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def resolve_exits(entries: DataFrame, bars: DataFrame, scope=()) -> DataFrame:
    """Exit of each entry: its stop, else a SELL, else the end of the data; the entry day itself never exits.

    Only stops need a search. It ends at the entry's next SELL bar, and an entry meets its bars by calendar bins.
    """
    keys = (*scope, "instrument")
    until = F.coalesce(F.col("next_sell.date"), F.col("last_bar.date"))
    touched = first_within(
        entries, bars, keys, F.col("entry_date"), until, "date", ["low"], lambda bar: bar["low"] <= F.col("stop_loss")
    )
    out = touched.withColumn("_stop", F.col("first.date")).drop("first")
    if scope:
        out = out.join(bars.groupBy(*scope).agg(F.max("date").alias("_end")), list(scope))
    else:
        out = out.withColumn("_end", bars.agg(F.max("date")).scalar())
    closes_at_end = F.col("last_bar.date") == F.col("_end")
    pick = lambda a, b, c: F.when(F.col("_stop").isNotNull(), a).when(F.col("next_sell").isNotNull(), b).when(closes_at_end, c)
    return out.withColumns(
        {
            "exit_date": pick(F.col("_stop"), F.col("next_sell.date"), F.col("last_bar.date")),
            "exit_price": pick(F.col("stop_loss"), F.col("next_sell.close"), F.col("last_bar.close")),
            "exit_reason": pick(F.lit("stop_loss"), F.lit("signal_sell"), F.lit("end_of_data")),
        }
    ).filter(F.col("exit_date").isNotNull()).drop("_stop", "_end", "next_sell", "last_bar")


def entries_of(candidates: DataFrame, cfg: Settings = DEFAULTS, nav: float | None = None, keep=()) -> DataFrame:
    """Entry records: price, stop (5 % below where none was set) and shares bought with the sized cash."""
    cash = (cfg.capital if nav is None else nav) * size_fraction(cfg)
    return candidates.select(
        *keep,
        "instrument",
        F.col("date").alias("entry_date"),
        F.col("close").alias("entry_price"),
        F.coalesce("Stop_Loss", F.col("close") * 0.95).alias("stop_loss"),
        (cash / (F.col("close") * (1 + cfg.cost))).alias("shares"),
        F.col("Confidence").alias("entry_confidence"),
        F.coalesce("Regime_Label", F.lit("SIDEWAYS")).alias("entry_regime"),
        *[c for c in ("next_sell", "last_bar") if c in candidates.columns],
    )


def round_trip(trades: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """pnl, return_pct and holding_days (calendar) net of costs on both sides."""
    paid = F.col("shares") * F.col("entry_price") * (1 + cfg.cost)
    got = F.col("shares") * F.col("exit_price") * (1 - cfg.cost)
    return trades.withColumns(
        {
            "pnl": got - paid,
            "return_pct": F.when(paid > 0, (got - paid) / F.nullif(paid, F.lit(0.0))).otherwise(0.0),
            "holding_days": F.datediff("exit_date", "entry_date"),
        }
    )


def pnl_series(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Profit or loss per trade in exit order: a distributed sort."""
    cols = ("exit_date", "entry_date", "instrument", "pnl", "return_pct", "holding_days", "exit_reason")
    return trades.select(*by, *cols, (F.col("pnl") >= 0).alias("won")).orderBy(*by, *cols[:3])


def log_stats(trades: DataFrame, by=("run_id",)) -> DataFrame:
    win = F.col("pnl") > 0
    return trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"),
        F.count_if(win).alias("n_wins"),
        F.avg(win.cast("int")).alias("win_rate"),
        _mean_or_zero(win, "pnl").alias("avg_win"),
        _mean_or_zero(~win, "pnl").alias("avg_loss"),
        profit_factor("pnl").alias("profit_factor"),
        F.avg("pnl").alias("expectancy"),
    )


def longest_losing_streak(trades: DataFrame, by=("run_id",)) -> DataFrame:
    """Longest run of losing trades in log order (exit date, entry date, instrument).

    Two levels, so a run that owns most of the trades is split by exit day: a day is summarised by its size, its
    losing prefix and suffix and its best streak; then the few day rows of a run are chained.
    """
    order = ("exit_date", "entry_date", "instrument")
    day = (*by, "exit_date")
    w = Window.partitionBy(*day).orderBy(*order[1:])
    rows = trades.select(*by, *order, (F.col("pnl") <= 0).alias("lost"))
    rows = rows.withColumn("_won", F.sum((~F.col("lost")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*day, "_won").agg(F.count_if("lost").alias("len"))
    days = runs.groupBy(*day).agg(
        F.max("len").alias("best"),
        F.max("_won").alias("wins"),
        F.coalesce(F.max(F.when(F.col("_won") == 0, F.col("len"))), F.lit(0)).alias("prefix"),
        F.max_by("len", "_won").alias("suffix"),
    )
    past = Window.partitionBy(*by).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_group", F.coalesce(F.sum((F.col("wins") > 0).cast("int")).over(past), F.lit(0)))
    chain = Window.partitionBy(*by, "_group").orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    # A group holds the all-losing days after a day with a win, plus the day that ends them.
    before = Window.partitionBy(*by).orderBy("_group").rangeBetween(-1, -1)
    opened = F.coalesce(F.max(F.when(F.col("wins") > 0, F.col("suffix"))).over(before), F.lit(0))
    days = days.withColumn("_open", opened)
    joined = F.col("_open") + F.sum("prefix").over(chain)
    days = days.withColumn("_joined", joined)
    return days.groupBy(*by).agg(F.greatest(F.max("best"), F.max("_joined")).alias("max_consecutive_losses"))
