"""Bar tables on storage: scan, write, freshness, merge."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import spread
from ..functions.lineage import settle
from ..operators.returns import prepare
from ..settings import DEFAULTS, Settings
from .calendar import last_trading_day
from .panels import BARS


def select_bars(bars: DataFrame, universe: DataFrame | Iterable[str] | None = None, start=None, end=None) -> DataFrame:
    """Bars of a universe between two dates, both inclusive. A universe table becomes a semi join."""
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    if isinstance(universe, DataFrame):
        bars = bars.join(universe.select("instrument"), "instrument", "left_semi")
    elif universe is not None:
        bars = bars.filter(F.col("instrument").isin(list(universe)))
    return bars.select(*[f.name for f in BARS])


def scan_bars(spark: SparkSession, path: str, format: str = "parquet", **selection) -> DataFrame:
    """Read bars with a fixed schema; the date filter prunes row groups. Delivered partitioned by instrument."""
    reader = spark.read.schema(BARS)
    bars = reader.csv(path, header=True) if format == "csv" else reader.format(format).load(path)
    return spread(select_bars(bars, **selection))


def one_bar_per_day(bars: DataFrame) -> DataFrame:
    """Enforce the panel key: of several rows for an instrument and day keep one, chosen by its values."""
    values = [f.name for f in BARS if f.name not in ("instrument", "date")]
    return (
        bars.withColumn("date", F.to_date("date"))
        .groupBy("instrument", "date")
        .agg(F.max(F.struct(*values)).alias("bar"))
        .select("instrument", "date", "bar.*")
    )


def _by_year(bars: DataFrame):
    """A writer of one file set per year, clustered by instrument."""
    bars = bars.withColumn("year", F.year("date")).repartition("year", "instrument")
    return bars.sortWithinPartitions("year", "instrument", "date").write.partitionBy("year")


def write_bars(bars: DataFrame, path: str) -> None:
    """A new table at `path`, in place of whatever is there. `upsert_bars` changes a table."""
    _by_year(bars.select(*[f.name for f in BARS])).mode("overwrite").parquet(path)


def _state(spark: SparkSession, path: str) -> str | None:
    """Whether a staged change of the table is complete (`ready`) or done (`applied`)."""
    try:
        row = spark.read.schema("state string").parquet(f"{path}.state").first()
    except AnalysisException:
        return None
    return row and row["state"]


def _set_state(spark: SparkSession, path: str, state: str) -> None:
    spark.range(1).select(F.lit(state).alias("state")).coalesce(1).write.mode("overwrite").parquet(f"{path}.state")


def recover_bars(spark: SparkSession, path: str) -> None:
    """Finish a change that was staged whole but not carried over to the table."""
    path = path.rstrip("/")
    if _state(spark, path) != "ready":
        return
    staged = spark.read.schema(BARS).parquet(f"{path}.staged")
    _by_year(staged).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    _set_state(spark, path, "applied")


def upsert_bars(new: DataFrame, path: str) -> None:
    """Merge rows into the table by (instrument, date): a new row replaces the stored one, all other stored rows stay.

    Only the years that `new` touches are read and rewritten. Of several new rows for a key one is kept, chosen by its values. The merged years
    are first written beside the table (`<path>.staged`) and marked as complete; only then do they replace the table's. A job lost before the
    mark leaves the table as it was, one lost after it is finished by the next call (or `recover_bars`): either way the call can be
    repeated. One writer at a time.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    recover_bars(spark, path)
    new = settle(one_bar_per_day(new.select(*[f.name for f in BARS])))
    years = [r[0] for r in new.select(F.year("date")).distinct().collect()]  # calendar years
    if not years:
        return
    try:
        stored = spark.read.schema(f"{_ddl(BARS)}, year int").parquet(path).filter(F.col("year").isin(years)).drop("year")
    except AnalysisException:  # no table yet
        stored = new.limit(0)
    values = F.struct(*[f.name for f in BARS if f.name not in ("instrument", "date")])
    both = stored.select("instrument", "date", F.lit(0).alias("age"), values.alias("bar")).unionByName(
        new.select("instrument", "date", F.lit(1).alias("age"), values.alias("bar"))
    )
    merged = both.groupBy("instrument", "date").agg(F.max(F.struct("age", "bar")).alias("last")).select("instrument", "date", "last.bar.*")
    _set_state(spark, path, "staging")
    merged.write.mode("overwrite").parquet(f"{path}.staged")
    _set_state(spark, path, "ready")
    recover_bars(spark, path)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def cluster_bars(bars: DataFrame, path: str, buckets: int, keys=("instrument",)) -> DataFrame:
    """Write rows bucketed by `keys` and sorted by date; scans deliver them hash-partitioned, so plans on the keys need no exchange.

    Only the files outlive the call: the catalog's name for them is dropped once the scan is resolved.
    """
    spark, name = bars.sparkSession, f"barloom_{uuid.uuid4().hex}"
    shaped = bars.repartition(buckets, *keys)  # one file a bucket
    shaped.write.bucketBy(buckets, *keys).sortBy(*keys, "date").option("path", path).saveAsTable(name)
    scan = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return scan


def freshness(bars: DataFrame, as_of) -> DataFrame:
    """Per instrument the newest bar and whether it is older than the last trading day at `as_of`."""
    return bars.groupBy("instrument").agg(F.max("date").alias("newest")).withColumn(
        "stale", F.col("newest") < last_trading_day(as_of)
    )


def load_series(bars: DataFrame, instrument: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """One ungated series (a benchmark) with returns."""
    return prepare(bars.filter(F.col("instrument") == instrument), cfg)


def extend(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Add instruments; where both have one, the extra table's rows replace the base rows."""
    known = extra.select("instrument").distinct()
    return base.join(known, "instrument", "left_anti").unionByName(extra)


def reconcile(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """(instrument, loaded): which requested instruments are present."""
    present = loaded.select("instrument").distinct().withColumn("_hit", F.lit(True))
    return (
        requested.select("instrument")
        .distinct()
        .join(present, "instrument", "left")
        .select("instrument", F.col("_hit").isNotNull().alias("loaded"))
    )
