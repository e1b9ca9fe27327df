"""Small planted series built from fixed arithmetic and checked-in seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd

COLUMNS = ["instrument", "date", "open", "high", "low", "close", "volume"]


def table(name: str, open_, high, low, close, volume) -> pd.DataFrame:
    days = pd.bdate_range("2017-03-01", periods=len(close)).date
    columns = dict(zip(COLUMNS, (name, days, open_, high, low, close, volume), strict=True))
    return pd.DataFrame(columns)[COLUMNS]


def walk(name: str, n: int, seed: int, mu=0.0004, sigma=0.011) -> pd.DataFrame:
    """A random walk whose bars reach from the previous close to the close, and a little beyond."""
    rng = np.random.default_rng(seed)
    path = 80 * np.cumprod(1 + rng.normal(mu, sigma, n + 1))
    before, close = path[:-1], path[1:]
    reach = rng.uniform(0.001, 0.009, (2, n))
    top, bottom = np.maximum(before, close) * (1 + reach[0]), np.minimum(before, close) * (1 - reach[1])
    return table(name, before, top, bottom, close, rng.integers(20_000, 900_000, n).astype(float))


SEGMENTS = {"calm": (300, 0.0006, 0.007), "slump": (110, -0.0065, 0.027), "recovery": (240, 0.0028, 0.013)}


def planted_regimes(name: str = "R", seed: int = 5) -> pd.DataFrame:
    """A calm stretch, a violent slump and a recovery, of the lengths, drifts and volatilities in `SEGMENTS`."""
    rng = np.random.default_rng(seed)
    moves = [rng.normal(drift, vol, n) for n, drift, vol in SEGMENTS.values()]
    path = 50 * np.cumprod(1 + np.concatenate([[0.0], *moves]))
    before, close = path[:-1], path[1:]
    half = 0.3 * np.abs(close - before) + 0.002 * close
    return table(name, before, np.maximum(before, close) + half, np.minimum(before, close) - half, close, np.full(len(close), 4e5))
