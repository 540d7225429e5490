"""Broadcast only what has a proven size bound.

Sides whose row count grows with the data (per-ticker maxima, latest rows) get no hint:
after the shuffle map stage Adaptive Query Execution knows the real byte size of each join
side and turns a sort-merge join into a broadcast hash join only below
``spark.sql.adaptive.autoBroadcastJoinThreshold``. A dimension that is small by nature goes
through ``checked_broadcast``, which counts it first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (at most one more is
    counted), as it is otherwise."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
