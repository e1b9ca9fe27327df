"""Equity-curve analytics per run. A run has one row per day, so its windows are bounded by the calendar."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import change, filled, ratio, rolled, running, series
from ..functions.lineage import settle
from ..settings import DEFAULTS, Settings

RUN = ("run_id",)
BENCHMARK_LEAST = 30


def with_returns(equity: DataFrame) -> DataFrame:
    """Daily return, 0 on the first day."""
    return equity.withColumn("ret", F.coalesce(change(F.col("equity"), 1, RUN), F.lit(0.0)))


def with_drawdown(equity: DataFrame) -> DataFrame:
    return equity.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(running(RUN))) - 1)


def sharpe(ret: Column, cfg: Settings = DEFAULTS, rf: float | None = None) -> Column:
    """Annualised, on the sigma of raw returns; 0 without spread."""
    rf = cfg.rf_daily if rf is None else rf
    value = (F.avg(ret) - rf) / F.nullif(F.stddev_samp(ret), F.lit(0.0)) * sqrt(cfg.trading_days)
    return F.coalesce(value, F.lit(0.0))


def sortino(ret: Column, cfg: Settings = DEFAULTS) -> Column:
    """Excess mean over the sigma of the negative returns; 0 with fewer than two of them."""
    down = F.when(ret < 0, ret)
    value = (F.avg(ret) - cfg.rf_daily) / F.nullif(F.stddev_samp(down), F.lit(0.0)) * sqrt(cfg.trading_days)
    return F.coalesce(F.when(F.count(down) > 1, value), F.lit(0.0))


def growth_rate() -> Column:
    return F.pow(F.col("final") / F.col("initial"), 1 / F.col("years")) - 1


def metrics(equity: DataFrame, cfg: Settings = DEFAULTS, by=()) -> DataFrame:
    """One row per run: span, growth, risk ratios, worst drawdown and its first day."""
    df = with_drawdown(with_returns(equity))
    out = df.groupBy(*RUN, *by).agg(
        F.count("*").alias("n"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.min_by("equity", "date").alias("initial"),
        F.max_by("equity", "date").alias("final"),
        (F.stddev_samp("ret") * sqrt(cfg.trading_days)).alias("ann_vol"),
        sharpe(F.col("ret"), cfg).alias("sharpe"),
        sortino(F.col("ret"), cfg).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.min(F.struct("drawdown", "date"))["date"].alias("max_drawdown_date"),
    ).filter(F.col("n") >= 2)
    out = out.withColumn("years", F.greatest(F.datediff("end", "start") / 365.25, F.lit(1e-9)))
    out = out.withColumn("total_return", F.col("final") / F.col("initial") - 1).withColumn("cagr", growth_rate())
    calmar = F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs(F.nullif(F.col("max_drawdown"), F.lit(0.0))))
    return out.withColumn("calmar", F.coalesce(calmar, F.lit(0.0)))


def rolling_sharpe(returns: DataFrame, window: int = 126, cfg: Settings = DEFAULTS) -> DataFrame:
    mean = rolled(F.avg, F.col("ret"), window, RUN)
    sigma = rolled(F.stddev_samp, F.col("ret"), window, RUN)
    return returns.withColumn("rolling_sharpe", ratio(mean - cfg.rf_daily, sigma) * sqrt(cfg.trading_days))


def align_benchmark(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark close on the run's own days, carried forward, and its return (0 where unknown).

    The benchmark has one row per calendar day, which bounds the broadcast.
    """
    closes = F.broadcast(benchmark.select("date", F.col("close").alias("_bench")))
    df = equity.join(closes, "date", "left")
    df = df.withColumn("bench", filled("_bench", None, RUN)).drop("_bench")
    return df.withColumn("bench_ret", F.coalesce(change(F.col("bench"), 1, RUN), F.lit(0.0)))


def versus_benchmark(aligned: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """beta, annualised alpha and R2 of excess returns; outperformance over buy and hold."""
    x, y = F.col("bench_ret") - cfg.rf_daily, F.col("ret") - cfg.rf_daily
    fit = aligned.groupBy(*RUN).agg(
        F.count("*").alias("_n"),
        F.regr_slope(y, x).alias("beta"),
        (F.regr_intercept(y, x) * cfg.trading_days).alias("alpha"),
        F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias("r_squared"),
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("_total"),
        (F.exp(F.sum(F.log1p("bench_ret"))) - 1).alias("_bench_total"),
    )
    known = F.col("_n") > BENCHMARK_LEAST
    return fit.select(
        *RUN,
        *[F.when(known & F.col("beta").isNotNull(), F.col(c)).alias(c) for c in ("alpha", "beta", "r_squared")],
        F.when(known, F.col("_total") - F.col("_bench_total")).alias("outperformance"),
    )


def growth_of_one(aligned: DataFrame) -> DataFrame:
    """Run and benchmark as multiples of their first value; a late benchmark is extended backwards."""
    whole = series(RUN).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = aligned.withColumn("_first_bench", F.first("bench", ignorenulls=True).over(whole))
    return df.select(
        *RUN,
        "date",
        (F.col("equity") / F.first("equity").over(whole)).alias("growth"),
        (F.coalesce("bench", "_first_bench") / F.col("_first_bench")).alias("bench_growth"),
    )


def drawdown_episode(equity: DataFrame) -> DataFrame:
    """Peak, trough and recovery day (the last day if never recovered) of the worst drawdown."""
    whole = Window.partitionBy(*RUN)
    df = with_drawdown(equity).withColumn("_worst", F.min(F.struct("drawdown", "date")).over(whole))
    df = df.withColumn("trough", F.col("_worst.date"))
    df = df.withColumn("_peak", F.max(F.when(F.col("date") <= F.col("trough"), F.col("equity"))).over(whole))
    d = F.col("date")
    return df.groupBy(*RUN).agg(
        F.min(F.when((d <= F.col("trough")) & (F.col("equity") == F.col("_peak")), d)).alias("peak"),
        F.first("trough").alias("trough"),
        F.coalesce(
            F.min(F.when((d >= F.col("trough")) & (F.col("equity") >= F.col("_peak")), d)), F.max(d)
        ).alias("recovery"),
        F.min("drawdown").alias("max_drawdown"),
    )


def monthly_grid(returns: DataFrame) -> DataFrame:
    """run x year rows, months m1..m12 in percent; months inside the span without bars compound to 0."""
    month = F.trunc("date", "month")
    got = returns.groupBy(*RUN, month.alias("month")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("r"))
    span = got.groupBy(*RUN).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(*RUN, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    full = months.join(got, [*RUN, "month"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)) * 100)
    return full.groupBy(*RUN, F.year("month").alias("year")).agg(
        *[F.max(F.when(F.month("month") == m, F.col("r"))).alias(f"m{m}") for m in range(1, 13)]
    )


def histogram(values: DataFrame, column: str, bins: int = 60, by=RUN) -> DataFrame:
    """Equal-width bins between the smallest and largest value, with mean and sigma of the group.

    The ends come from a grouped aggregate joined back, so a large group is never gathered in one window.
    """
    known = values.filter(F.col(column).isNotNull())
    ends = known.groupBy(*by).agg(
        F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sigma")
    )
    place = F.floor((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    df = known.join(ends, list(by)).withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return df.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.first(F.col("_lo") + F.col("bin") * width).alias("low"),
        F.first("mean").alias("mean"),
        F.first("sigma").alias("sigma"),
    )


METRICS = ("sharpe", "cagr", "max_drawdown", "ann_vol")


def compare(in_sample: DataFrame, out_of_sample: DataFrame) -> DataFrame:
    """(run_id, metric, in_sample, out_of_sample, delta); no delta against a zero or missing base."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*RUN, *METRICS).unpivot(list(RUN), list(METRICS), "metric", name)

    both = long(in_sample, "in_sample").join(long(out_of_sample, "out_of_sample"), [*RUN, "metric"])
    return both.withColumn(
        "delta", F.when(F.col("in_sample") != 0, F.col("out_of_sample") - F.col("in_sample"))
    )


def tear_sheet(equity: DataFrame, trades: DataFrame, benchmark: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """All run statistics in one row: equity metrics, trade statistics, benchmark comparison."""
    from .outcomes import log_stats, longest_losing_streak

    equity, trades = settle(equity), settle(trades)  # each is read twice
    stats = log_stats(trades).join(longest_losing_streak(trades), "run_id")
    aligned = with_returns(align_benchmark(equity, benchmark))
    df = metrics(equity, cfg).join(versus_benchmark(aligned, cfg), "run_id").join(stats, "run_id", "left")
    zero = ("n_trades", "n_wins", "win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy", "max_consecutive_losses")
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    return df.withColumnsRenamed({"initial": "initial_capital", "final": "final_nav"}).drop("n")
