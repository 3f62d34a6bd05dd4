"""Rounding and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 1) -> Column:
    """Halves go towards plus infinity, on the binary value itself."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Into [low, high]; null, NaN and infinities become low."""
    wild = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(wild, F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), c)))
