"""Returns on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEYS, change, filled
from ..settings import DEFAULTS, Settings

PRICES = ("open", "high", "low", "close")


def fill_short_gaps(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    """Carry prices over gaps of at most `return_fill` rows, then drop rows without a close."""
    return bars.withColumns({c: filled(c, cfg.return_fill, keys) for c in PRICES}).filter(
        F.col("close").isNotNull()
    )


def with_returns(bars: DataFrame, keys=KEYS) -> DataFrame:
    """Daily_Return (simple) and Adj_Return (log); NULL on the first bar."""
    simple = change(F.col("close"), 1, keys)
    return bars.withColumn("Daily_Return", simple).withColumn("Adj_Return", F.log1p("Daily_Return"))


def prepare(bars: DataFrame, cfg: Settings = DEFAULTS, keys=KEYS) -> DataFrame:
    return with_returns(fill_short_gaps(bars, cfg, keys), keys)
