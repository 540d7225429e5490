"""Typed table layouts and the schema-tolerant projection used before every sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()
D = T.DoubleType()
L = T.LongType()
I = T.IntegerType()
S = T.StringType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BAR_KEY = ["ticker", "timestamp"]

BARS = _st(("ticker", S), ("timestamp", TS), ("open", D), ("high", D), ("low", D),
           ("close", D), ("volume", L))

INDICATORS = _st(("ticker", S), ("timestamp", TS), ("close", D), ("sma20", D), ("sma50", D),
                 ("rsi", D), ("vortex_positive", D), ("vortex_negative", D))

#: A ticker's last bars and how many it has seen: the rolling state as a table.
ROLLING_TAIL = _st(("ticker", S), ("timestamp", TS), ("high", D), ("low", D), ("close", D), ("seen", L))

#: One row a ticker and date: see ``operators.bar_stats``.
BAR_STATS = _st(("ticker", S), ("bar_count", L), ("repeated_keys", L), ("first_bar", TS), ("last_bar", TS))

SIGNALS = _st(("ticker", S), ("timestamp", TS), ("signal", S), ("signal_score", D),
              ("close", D), ("sma20", D), ("sma50", D), ("rsi", D), ("vortex_positive", D),
              ("vortex_negative", D), ("stop_loss", D), ("take_profit", D))

SIGNALS_GEN1 = _st(("ticker", S), ("timestamp", TS), ("signal", S), ("close", D),
                   ("sma20", D), ("sma50", D), ("rsi", D), ("vortex_positive", D),
                   ("vortex_negative", D))

PORTFOLIO = _st(("ticker", S), ("holdings", L), ("avg_entry_price", D), ("current_price", D),
                ("unrealized_pnl", D), ("realized_pnl", D), ("total_trades", I),
                ("last_signal", S), ("last_signal_time", TS))

PORTFOLIO_GEN1 = _st(("ticker", S), ("holdings", L), ("avg_entry_price", D),
                     ("current_price", D), ("unrealized_pnl", D), ("last_signal", S),
                     ("last_signal_time", TS))

TRADE_LOG = _st(("trade_id", L), ("ticker", S), ("signal", S), ("signal_score", D),
                ("price", D), ("quantity", L), ("pnl_realized", D), ("stop_loss", D),
                ("take_profit", D), ("timestamp", TS), ("created_at", TS))

DQ_EVENTS = _st(("event_id", L), ("event_type", S), ("ticker", S), ("message", S),
                ("bar_count", I), ("detected_at", TS))

# Rolling state kept per ticker by the stream operator.
STATE_ROW = _st(("timestamp", TS), ("high", D), ("low", D), ("close", D))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema`` in order: cast present columns, add missing ones as typed nulls.

    Additive schema evolution: an older frame (e.g. generation-1 signals) gains the new
    columns as nulls, a newer one loses nothing it declares.
    """
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
