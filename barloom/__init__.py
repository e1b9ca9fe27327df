"""barloom: market-panel analytics as Spark DataFrame transformations."""

from .settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
