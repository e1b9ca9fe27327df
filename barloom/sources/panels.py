"""Test panels derived from the order tables: bars, benchmark, factors, holdings, quotes.

Closes are rounded to four decimals, as quoted prices are; rates are averaged as whole cents so
that a bar does not depend on the order of its line items. Every builder starts with a grouped
aggregate (combined map-side), so a supplier or a day owning a large share of the line items
costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import running, series, spread

BARS = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame, scale: float) -> DataFrame:
    """(instrument, date, l_*) line items -> one bar per instrument and date."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / (100 * F.count("*"))
    day = lines.groupBy("instrument", "date").agg(
        (scale * (cents("l_discount") - 0.05)).alias("lr"),
        cents("l_tax").alias("tax"),
        F.max("l_discount").alias("top_discount"),
        F.max("l_tax").alias("top_tax"),
        F.sum("l_quantity").alias("volume"),
    )
    day = spread(day).withColumn("close", F.round(100 * F.exp(F.sum("lr").over(running())), 4))
    prev = F.lag("close").over(series())
    day = day.withColumn("open", F.coalesce(prev * (1 + 0.1 * (F.col("tax") - 0.04)), F.col("close")))
    return day.select(
        "instrument",
        "date",
        "open",
        (F.greatest("open", "close") * (1 + 0.1 * F.col("top_discount"))).alias("high"),
        (F.least("open", "close") * (1 - 0.1 * F.col("top_tax"))).alias("low"),
        "close",
        "volume",
    )


LINE = ("l_discount", "l_tax", "l_quantity")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument per supplier."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("date"), *LINE
    )
    return _bars(lines, 0.3)


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument per brand; a bar per week."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("instrument"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), *LINE
        )
    )
    return _bars(lines, 0.8)


def benchmark_bars(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    """All line items as one market series."""
    day = F.date_trunc("week", "l_shipdate") if weekly else F.col("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("MARKET").alias("instrument"), F.to_date(day).alias("date"), *LINE
    )
    return _bars(lines, 0.8 if weekly else 0.3)


def defective_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with planted gaps, bad prices and jumps, by plain arithmetic on keys and row numbers.

    Short histories are planted too: every tenth supplier's bars after the ninetieth are dropped.
    """
    bars = daily_bars(spark, sf_dir).withColumn("n", F.row_number().over(series()).cast("long"))
    k = F.col("instrument").cast("long")
    gap = F.pmod(F.col("n") + k, F.lit(40)) < F.pmod(k, F.lit(8))
    bad = (F.pmod(k, F.lit(9)) == 4) & (F.col("n") == 30)
    jump = (F.pmod(k, F.lit(7)) == 2) & (F.pmod(F.col("n"), F.lit(150)) == 75)
    price = lambda c: F.when(gap, None).when(bad, 0.0).when(jump, F.col(c) * 2).otherwise(F.col(c))
    short = (F.pmod(k, F.lit(10)) == 3) & (F.col("n") > 90)
    return (
        bars.filter(~short)
        .withColumns({c: price(c) for c in ("open", "high", "low", "close")})
        .withColumn("volume", F.when(gap & (F.pmod(F.col("n"), F.lit(2)) == 0), None).otherwise(F.col("volume")))
        .drop("n")
    )


CUSTOMERS = 25


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group of `CUSTOMERS` consecutive customers every brand they spent on: (portfolio_id, instrument, amount, quantity, rank)."""
    spent = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.floor(F.col("o_custkey") / CUSTOMERS).cast("string").alias("portfolio_id"), F.col("p_brand").alias("instrument"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.sum("l_quantity").alias("quantity"))
    )
    w = Window.partitionBy("portfolio_id").orderBy(F.col("amount").desc(), "instrument")
    return spent.withColumn("rank", F.row_number().over(w))


def brand_sectors(bars: DataFrame) -> DataFrame:
    """(instrument, sector): brand number modulo 5."""
    number = F.regexp_extract("instrument", r"(\d+)", 1).cast("int")
    return bars.select("instrument").distinct().withColumn("sector", F.concat(F.lit("S"), number % 5))


def quotes(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Events as quotes (instrument, ts, last_price)."""
    return table(spark, sf_dir, "events").select(
        F.col(key).cast("string").alias("instrument"), "ts", F.col("value").alias("last_price")
    )
