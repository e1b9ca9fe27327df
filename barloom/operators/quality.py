"""Data-quality gates: one grouped pass per instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEYS, filled, series
from ..settings import DEFAULTS, Settings
from .returns import prepare

FIELDS = ("open", "high", "low", "close", "volume")


def checks(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    """Raw measurements: rows, missing_pct, zero_or_neg_prices, moves."""
    absent = [c for c in FIELDS if c not in bars.columns]
    for c in absent:
        bars = bars.withColumn(c, F.lit(None).cast("double"))
    marked = bars.select(
        *keys,
        "close",
        *[filled(c, cfg.quality_fill, keys).isNull().alias(f"_gone_{c}") for c in FIELDS],
        filled("close", None, keys).alias("_padded"),
        "date",
    )
    before = F.lag("_padded").over(series(keys))
    gone = F.lit(False)
    for c in FIELDS:
        gone = gone | F.col(f"_gone_{c}")
    move = F.abs(F.col("_padded") / F.nullif(before, F.lit(0.0)) - 1)
    return (
        marked.withColumns({"_move": move, "_gone": gone})
        .groupBy(*keys)
        .agg(
            F.count("*").alias("rows"),
            (F.lit(1.0) if absent else F.avg(F.col("_gone").cast("int"))).alias("missing_pct"),
            F.count_if(F.col("close") <= 0).alias("zero_or_neg_prices"),
            F.count_if(F.col("_move") > cfg.max_move).alias("moves"),
        )
    )


def report(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    """One verdict row per instrument; `reason` names the first failing gate."""
    few = F.col("rows") < cfg.min_rows
    gaps = F.col("missing_pct") > cfg.max_missing
    bad = F.col("zero_or_neg_prices") > 0
    reason = (
        F.when(few, F.format_string(f"too few rows (%d < {cfg.min_rows})", F.col("rows")))
        .when(
            gaps,
            F.format_string(f"missing pct %.1f%% > {cfg.max_missing * 100:.1f}%%", F.col("missing_pct") * 100),
        )
        .when(bad, F.format_string("%d zero/negative close prices", F.col("zero_or_neg_prices")))
        .otherwise("")
    )
    return checks(bars, cfg, keys).select(
        *keys,
        "rows",
        "missing_pct",
        "zero_or_neg_prices",
        F.when(reason == "", F.col("moves")).otherwise(F.lit(0)).alias("extreme_moves"),
        (reason == "").alias("passed"),
        reason.alias("reason"),
    )


def gate(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    """Bars of the instruments that passed, in one pass: the gates of `report` as windows over an instrument's bars."""
    whole = Window.partitionBy(*keys)
    gone = F.lit(False)
    for c in FIELDS:
        gone = gone | (filled(c, cfg.quality_fill, keys).isNull() if c in bars.columns else F.lit(True))
    marked = bars.withColumn("_gone", gone.cast("int"))
    passed = (
        (F.count("*").over(whole) >= cfg.min_rows)
        & (F.avg("_gone").over(whole) <= cfg.max_missing)
        & (F.count_if(F.col("close") <= 0).over(whole) == 0)
    )
    return marked.withColumn("_passed", passed).filter("_passed").drop("_gone", "_passed")


def load_universe(bars: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    return prepare(gate(bars, cfg), cfg)
