"""DQ-1..5 and SET-4: data-quality checks over a bar table, as event DataFrames.

Every check is an aggregate or a window; the driver never iterates over results.
Events share one layout (event_type, ticker, message, bar_count); ``to_event_log`` adds
the surrogate id and detection time for the append-only log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Params

# fixed values: event types
MISSING_BARS = "MISSING_BARS"
GAP_DETECTED = "GAP_DETECTED"
STALE_DATA = "STALE_DATA"
DUPLICATE_DETECTED = "DUPLICATE_DETECTED"
ALL_TICKERS = "ALL"

# fixed values: severity marks shown next to each event type; anything else shows "?"
EVENT_MARKS = {
    "API_ERROR": "X",
    "MISSING_BARS": "!",
    "DUPLICATE_DETECTED": "D",
    "STALE_DATA": "S",
    "GAP_DETECTED": "G",
    "INVALID_PRICE": "P",
    "EXTREME_SPIKE_REMOVED": "!",
}
UNKNOWN_MARK = "?"

EVENT_COLS = ["event_type", "ticker", "message", "bar_count"]


def bar_profile(bars: DataFrame) -> DataFrame:
    """AGG-2: bar count, first and last bar per ticker."""
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bar_count"),
                                      F.min("timestamp").alias("first_bar"),
                                      F.max("timestamp").alias("last_bar"))


def low_bar_count(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """DQ-1: MISSING_BARS for tickers with fewer bars than expected."""
    return low_bars(bar_profile(bars), p)


def low_bars(profile: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``low_bar_count`` of a ``bar_profile``."""
    return profile.where(F.col("bar_count") < p.min_expected_bars).select(
        F.lit(MISSING_BARS).alias("event_type"), "ticker",
        F.format_string(f"%d bars stored, at least {p.min_expected_bars} wanted", F.col("bar_count")).alias("message"),
        F.col("bar_count").cast("int").alias("bar_count"))


def previous_time(bars: DataFrame, bucket: str = "day") -> DataFrame:
    """``prev_ts``: the time of the ticker's previous bar on the same date. In buckets below
    a day the first bar of a bucket takes the last time of the nearest earlier bucket of
    that date, found over one row for each (ticker, bucket)."""
    b = bars.withColumn("_bk", F.date_trunc(bucket, "timestamp"))
    inside = F.lag("timestamp").over(Window.partitionBy("ticker", "_bk").orderBy("timestamp"))
    if bucket == "day":
        return b.withColumn("prev_ts", inside).drop("_bk")
    last = b.groupBy("ticker", "_bk").agg(F.max("timestamp").alias("_last"))
    day = Window.partitionBy("ticker", F.to_date("_bk")).orderBy("_bk")
    carry = last.select("ticker", "_bk", F.lag("_last").over(day).alias("_carry"))
    return b.withColumn("_in", inside).join(carry, ["ticker", "_bk"]) \
        .withColumn("prev_ts", F.coalesce("_in", "_carry")).drop("_bk", "_in", "_carry")


def intraday_gaps(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """WIN-2 + DQ-2: consecutive bars of a ticker on the same calendar date more than
    ``gap_threshold_minutes`` apart (whole minutes, truncated).

    Only same-date pairs count, so the lag is taken within (ticker, time bucket of a day or
    less): the same result as a lag over the whole ticker, but a ticker's history is spread
    over its buckets instead of one task."""
    prev = previous_time(bars.select("ticker", "timestamp"), p.order_bucket)
    g = prev.select("ticker", "timestamp", "prev_ts")
    gap = F.timestamp_diff("MINUTE", F.col("prev_ts"), F.col("timestamp"))
    return (g.where(F.col("prev_ts").isNotNull())
            .select("ticker", "prev_ts", "timestamp", gap.alias("gap_minutes"))
            .where((F.col("gap_minutes") > p.gap_threshold_minutes)
                   & (F.to_date("prev_ts") == F.to_date("timestamp"))))


def top_gaps(bars: DataFrame, p: Params = DEFAULT, limit: int | None = None) -> DataFrame:
    """TOP-4: largest gaps first, ties broken by ticker then time (a total order)."""
    n = limit or p.gap_report_limit
    return (intraday_gaps(bars, p)
            .orderBy(F.col("gap_minutes").desc(), "ticker", "timestamp")
            .limit(n))


def gap_events(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Every intraday gap becomes a GAP_DETECTED event (only the report is cut)."""
    g = intraday_gaps(bars, p)
    msg = F.format_string("%d minutes without a bar from %s to %s", F.col("gap_minutes"),
                          F.col("prev_ts").cast("string"), F.col("timestamp").cast("string"))
    return g.select(F.lit(GAP_DETECTED).alias("event_type"), "ticker", msg.alias("message"),
                    F.col("gap_minutes").cast("int").alias("bar_count"))


def freshness(bars: DataFrame, as_of: Column, p: Params = DEFAULT) -> DataFrame:
    """AGG-3 + DQ-3: STALE_DATA when the newest bar is older than ``stale_hours``."""
    latest = bars.agg(F.max("timestamp").alias("latest"))
    secs = F.unix_timestamp(as_of) - F.unix_timestamp("latest")
    hours = F.try_divide(secs.cast("double"), F.lit(3600.0))
    shown = F.round(hours * 10) / 10
    return (latest.where(F.col("latest").isNotNull() & (hours > p.stale_hours))
            .select(F.lit(STALE_DATA).alias("event_type"), F.lit(ALL_TICKERS).alias("ticker"),
                    F.format_string("newest bar is %.1f hours old (%s)", shown,
                                    F.col("latest").cast("string")).alias("message"),
                    F.lit(0).alias("bar_count")))


def duplicate_keys(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG-4: keys that occur more than once, with their count."""
    keys = keys or schemas.BAR_KEY
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def duplicate_events(bars: DataFrame) -> DataFrame:
    """DQ-4: one DUPLICATE_DETECTED event when any key is duplicated."""
    return repeated_key_event(duplicate_keys(bars).agg(F.count(F.lit(1)).alias("n")))


def repeated_key_event(repeated: DataFrame) -> DataFrame:
    """The event of one row ``n``, the number of repeated keys."""
    return repeated.where(F.col("n") > 0).select(
        F.lit(DUPLICATE_DETECTED).alias("event_type"), F.lit(ALL_TICKERS).alias("ticker"),
        F.format_string("%d bar keys are stored more than once", F.col("n")).alias("message"),
        F.col("n").cast("int").alias("bar_count"))


def union_events(*frames: DataFrame) -> DataFrame:
    """SET-4: concatenate event frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*EVENT_COLS) for f in frames])


def event_mark() -> Column:
    """DQ-5: severity mark per event type, '?' when unknown."""
    m = F.create_map(*[x for k, v in EVENT_MARKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col("event_type")), F.lit(UNKNOWN_MARK))


def to_event_log(ev: DataFrame, as_of: Column) -> DataFrame:
    """SNK-9: surrogate id from the natural content (retry-safe) and detection time."""
    out = ev.withColumn("detected_at", as_of).withColumn(
        "event_id", F.xxhash64("event_type", "ticker", "message", "detected_at"))
    return schemas.conform(out, schemas.DQ_EVENTS)


def recent_events(log: DataFrame, limit: int = 15) -> DataFrame:
    """TOP-3 + SRV-8: newest events first with their mark; ties broken by content."""
    return (log.select("event_type", "ticker", "message", "detected_at", event_mark().alias("mark"))
            .orderBy(F.col("detected_at").desc(), "event_type", "ticker", "message")
            .limit(limit))
