"""Adapters from the driver's test tables to bar-shaped inputs.

Each adapter is one DataFrame function; the oracle module holds the same definition as
a SQL CTE. The market data the engine is built for is OHLCV bars; the test tables are
``events`` (timestamped values) and ``orders``, so these adapters derive bars, a symbol
dimension, a prior portfolio and a trade log from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.resample import bucket_start
from .tables import read_table

# fixed values: symbol that has no events (exercises the missing-source path)
ABSENT_SYMBOL = "ABSENT"
# fixed values: split points used to build overlapping / historical inputs
SPLIT_TS = "2024-01-15 12:00:00"
UPSERT_TARGET_END = "2024-01-20 00:00:00"
UPSERT_SOURCE_START = "2024-01-10 00:00:00"
REDELIVERED_DAY = "2024-01-15"
AS_OF = "2024-02-01 00:00:00"


def as_of_lit(ts: str = AS_OF) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def bars_from_events(ev: DataFrame, minutes: int, price_offset: float = 0.0) -> DataFrame:
    """OHLCV bars per event type: open at the first tick, close at the last, volume = sum k."""
    price = F.col("value") + F.lit(price_offset) if price_offset else F.col("value")
    ticks = ev.select(F.col("event_type").alias("ticker"), F.col("ts"),
                      price.alias("price"), _k().alias("k"))
    return (ticks
            .groupBy("ticker", bucket_start("ts", minutes).alias("timestamp"))
            .agg(F.min_by("price", "ts").alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", "ts").alias("close"),
                 F.sum("k").cast("long").alias("volume")))


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(events(spark, sf_dir), 60)


def bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(events(spark, sf_dir), 5, 50.0)


def bars_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(events(spark, sf_dir), 10, 50.0)


def user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event, keyed by user: thousands of tickers with a real high/low spread."""
    ev = events(spark, sf_dir)
    k = _k().cast("double")
    return ev.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("open"),
        (F.col("value") + k / 10).alias("high"),
        F.greatest(F.col("value") - (F.lit(99.0) - k) / 10, F.lit(0.005)).alias("low"),
        F.col("value").alias("close"),
        F.lit(1).cast("long").alias("volume"))


def _slot() -> Column:
    return F.floor(F.unix_timestamp("timestamp") / 600).cast("long")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-minute bars with faults injected by time slot (one rule per modulus)."""
    b = _slot()
    return bars_10m(spark, sf_dir).select(
        "ticker", "timestamp", "open",
        F.when(b % 79 == 0, F.col("low") * 0.5).otherwise(F.col("high")).alias("high"),
        F.when(b % 89 == 0, F.lit(-1.0)).otherwise(F.col("low")).alias("low"),
        F.when(b % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("close")).alias("close"),
        F.when(b % 83 == 0, F.lit(-5).cast("long")).otherwise(F.col("volume")).alias("volume"))


def symbol_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor symbol -> display ticker, one row per event type plus one absent symbol."""
    types = events(spark, sf_dir).select(F.col("event_type").alias("ticker")).distinct()
    absent = spark.range(1).select(F.lit(ABSENT_SYMBOL).alias("ticker"))
    dim = types.unionByName(absent)
    return dim.select(F.concat(F.upper("ticker"), F.lit(".EV")).alias("symbol"), "ticker")


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-minute bars as a vendor would land them: vendor symbol, capitalised names,
    numbers as text, one unparsable close per 97 slots."""
    b = bars_5m(spark, sf_dir)
    slot = F.floor(F.unix_timestamp("timestamp") / 300).cast("long")
    return b.select(
        F.concat(F.upper("ticker"), F.lit(".EV")).alias("symbol"),
        F.col("timestamp").alias("Datetime"),
        F.col("open").cast("string").alias("Open"),
        F.col("high").cast("string").alias("High"),
        F.col("low").cast("string").alias("Low"),
        F.when(slot % 97 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("Close"),
        F.col("volume").cast("string").alias("Volume"))


def portfolio_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior portfolio over user tickers (one per user with user_id % 5 <> 0)."""
    ev = events(spark, sf_dir)
    first = (ev.groupBy("user_id")
             .agg(F.min_by("value", "ts").alias("first_close"))
             .where(F.col("user_id") % 5 != 0))
    uid = F.col("user_id")
    realized = F.when(uid % 7 == 0, F.lit(None)).otherwise(uid)
    return schemas.conform(first.select(
        F.concat(F.lit("U"), uid.cast("string")).alias("ticker"),
        ((uid % 4) * 100).alias("holdings"),
        F.col("first_close").alias("avg_entry_price"),
        F.col("first_close").alias("current_price"),
        F.lit(0.0).alias("unrealized_pnl"),
        realized.cast("double").alias("realized_pnl"),
        realized.cast("int").alias("total_trades")), schemas.PORTFOLIO)


def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade log derived from orders: one trade per order."""
    o = read_table(spark, sf_dir, "orders")
    m = F.col("o_custkey") % 5
    signal = (F.when(m <= 1, "BUY").when(m == 2, "SELL").when(m == 3, "STOP_LOSS")
              .otherwise("TAKE_PROFIT"))
    pnl = F.when(m <= 1, F.lit(0.0)).otherwise(((F.col("o_custkey") % 21) - 10) * 1.5)
    return schemas.conform(o.select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderpriority").alias("ticker"),
        signal.alias("signal"),
        F.col("o_totalprice").alias("price"),
        F.lit(100).alias("quantity"),
        pnl.alias("pnl_realized"),
        F.col("o_orderdate").alias("timestamp")), schemas.TRADE_LOG)
