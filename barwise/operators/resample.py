"""AGG-1: resample OHLCV bars to a coarser, midnight-aligned, left-closed interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_start(ts: str | Column, minutes: int) -> Column:
    """Start of the tumbling ``minutes`` window holding ``ts`` (epoch aligned, so
    midnight aligned for any divisor of a day). Works on TIMESTAMP_NTZ and in streams."""
    return F.window(ts, f"{minutes} minutes").start


def ohlcv_aggs(ts: str = "timestamp") -> list[Column]:
    """first open / max high / min low / last close / sum volume; first and last skip
    nulls because min_by / max_by ignore rows whose ordering key is null."""
    t = F.col(ts)
    return [
        F.min_by("open", F.when(F.col("open").isNotNull(), t)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), t)).alias("close"),
        F.sum("volume").cast("long").alias("volume"),
    ]


def resample(bars: DataFrame, minutes: int = 10) -> DataFrame:
    """Group bars by (ticker, window) with partial aggregation before the shuffle.

    Windows whose closes are all null are dropped (an empty window has no close).
    """
    return (bars
            .groupBy("ticker", bucket_start("timestamp", minutes).alias("timestamp"))
            .agg(*ohlcv_aggs())
            .where(F.col("close").isNotNull()))
