"""Engine-independent rounding for display and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int) -> Column:
    """round(x * 10^p) / 10^p: the product is one IEEE double and its integer rounding
    (half away from zero) has no decimal-string ambiguity, so every engine agrees."""
    k = float(10 ** places)
    return F.round(x * k) / k
