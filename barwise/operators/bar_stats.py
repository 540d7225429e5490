"""Mergeable daily statistics of the stored bars, kept in step by touched dates.

One row for each (ticker, date): how many rows, how many distinct keys more than once, first and last
time. Counts, minima and maxima merge by adding and comparing, so the checks and reads that
only need them (bars per ticker, low counts, freshness, repeated keys, table size) add up a
few rows a day instead of scanning the bars. A key has one date, so repeated keys never
stand in two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Params
from . import quality as Q
from . import versions as VT


def daily(bars: DataFrame) -> DataFrame:
    """(date, ticker, ...) of bars with their ``date``."""
    per_key = bars.groupBy("date", *schemas.BAR_KEY).agg(F.count("*").alias("_n"))
    return per_key.groupBy("date", "ticker").agg(
        F.sum("_n").alias("bar_count"), F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.min("timestamp").alias("first_bar"), F.max("timestamp").alias("last_bar"))


def refresh(spark: SparkSession, bars_path: str, stats_path: str) -> VT.Manifest:
    """Bring the statistics in step with the newest version of the bar table."""
    return VT.derive(spark, bars_path, stats_path, schemas.BARS, daily)


def read(spark: SparkSession, stats_path: str) -> DataFrame:
    return VT.read(spark, stats_path, schemas.BAR_STATS)


def bar_profile(stats: DataFrame) -> DataFrame:
    """AGG-2 from the statistics."""
    return stats.groupBy("ticker").agg(F.sum("bar_count").alias("bar_count"), F.min("first_bar").alias("first_bar"),
                                       F.max("last_bar").alias("last_bar"))


def checks(stats: DataFrame, as_of: Column, p: Params = DEFAULT) -> DataFrame:
    """DQ-1, DQ-3 and DQ-4 events, as ``quality`` finds them in the bars."""
    newest = stats.select(F.col("last_bar").alias("timestamp"))
    repeated = stats.agg(F.sum("repeated_keys").alias("n"))
    return Q.union_events(Q.low_bars(bar_profile(stats), p), Q.freshness(newest, as_of, p),
                          Q.repeated_key_event(repeated))


def row_count(stats: DataFrame, name: str) -> DataFrame:
    """AGG-9 for the bar table: (tbl, rows)."""
    return stats.agg(F.coalesce(F.sum("bar_count"), F.lit(0)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
