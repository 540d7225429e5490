"""SRV-1..10: dashboard reads as DataFrame functions (no SQL text, parameters bound
as literals), plus the distributed running sum behind the equity curve (WIN-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from .signals import annotation

SIGNAL_DISPLAY = ["timestamp", "signal", "signal_score", "close", "sma20", "sma50", "rsi",
                  "vortex_positive", "vortex_negative", "stop_loss", "take_profit"]
TRADE_DISPLAY = ["trade_id", "ticker", "signal", "signal_score", "price", "quantity",
                 "pnl_realized", "stop_loss", "take_profit", "timestamp"]


def tickers(bars: DataFrame) -> DataFrame:
    """SRV-1 / AGG-7: distinct tickers in order."""
    return bars.select("ticker").distinct().orderBy("ticker")


def performance_summary(log: DataFrame) -> DataFrame:
    """SRV-4 / AGG-8: one global aggregate over the trade log.

    win_rate is wins * 100 / non-zero trades rounded half up to one decimal, computed
    in exact integer arithmetic (the decimal result of the reference formula).
    """
    pnl, sig = F.col("pnl_realized"), F.col("signal")
    agg = log.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(sig == "BUY").alias("buy_count"),
        F.count_if(sig == "SELL").alias("sell_count"),
        F.count_if(sig.isin("STOP_LOSS", "TAKE_PROFIT")).alias("auto_exits"),
        F.sum(F.coalesce(pnl, F.lit(0.0))).alias("_pnl"),
        F.avg(F.when(pnl > 0, pnl)).alias("_win"),
        F.avg(F.when(pnl < 0, pnl)).alias("_loss"),
        F.count_if(pnl > 0).alias("_wins"),
        F.count_if(pnl != 0).alias("_nz"))
    nz = F.col("_nz")
    rate = F.when(nz > 0, F.expr("(_wins * 2000 + _nz) div (2 * _nz)") / 10.0)
    return agg.select(
        "total_trades", "buy_count", "sell_count", "auto_exits",
        round_half_up(F.col("_pnl"), 2).alias("total_pnl"),
        round_half_up(F.col("_win"), 2).alias("avg_win"),
        round_half_up(F.col("_loss"), 2).alias("avg_loss"),
        rate.cast("double").alias("win_rate"))


def performance_text(summary: DataFrame) -> DataFrame:
    """SRV-4 display strings; null metrics show ``N/A``."""
    # format_string renders a null argument as text, so nulls are caught first
    def shown(fmt: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string(fmt, F.col(c))).otherwise(F.lit("N/A"))
    return summary.select(
        F.col("total_trades").cast("string").alias("total_trades"),
        shown("$%.2f", "total_pnl").alias("realized_pnl"),
        shown("%.1f%%", "win_rate").alias("win_rate"),
        shown("$%.2f", "avg_win").alias("avg_win"), shown("$%.2f", "avg_loss").alias("avg_loss"))


def running_sum_by_time(df: DataFrame, value: str, ts: str = "timestamp",
                        out: str = "cumulative", bucket_unit: str = "day") -> DataFrame:
    """SUM(value) OVER (ORDER BY ts) with the default RANGE frame (tied times share one
    value), without sending every row through one partition.

    1. collapse to one row per distinct time (partial aggregation);
    2. total per time bucket (``bucket_unit``) and a running offset over the buckets --
       one row per bucket, the only single-partition step;
    3. running sum inside each bucket, partitioned by bucket, plus the bucket offset.
    """
    per_ts = df.groupBy(ts).agg(F.sum(value).alias("_ts_sum")).withColumn(
        "_b", F.date_trunc(bucket_unit, F.col(ts)))
    per_b = per_ts.groupBy("_b").agg(F.sum("_ts_sum").alias("_b_sum"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_b.select("_b", F.coalesce(F.sum("_b_sum").over(before), F.lit(0.0)).alias("_b_off"))
    inside = Window.partitionBy("_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    o = offsets.select(F.col("_b").alias("_ob"), "_b_off")
    staged = per_ts.withColumn("_in", F.sum("_ts_sum").over(inside))
    # rows without a time are one tie, before all others, as in the plain window
    cum = (staged.join(o, staged["_b"].eqNullSafe(o["_ob"]))
           .select(F.col(ts).alias("_at"), (F.col("_b_off") + F.col("_in")).alias(out)))
    return df.join(cum, df[ts].eqNullSafe(cum["_at"])).drop("_at")


def equity_curve(log: DataFrame, bucket_unit: str = "day") -> DataFrame:
    """SRV-7: realized trades with the running total of realized PnL, by time."""
    closed = log.where(F.col("pnl_realized").isNotNull() & (F.col("pnl_realized") != 0)) \
                .select("timestamp", "pnl_realized")
    return running_sum_by_time(closed, "pnl_realized", out="cumulative_pnl",
                               bucket_unit=bucket_unit).orderBy("timestamp")


def equity_curve_plain(log: DataFrame) -> DataFrame:
    """Reference form of SRV-7 (one global window; single partition). Tests only."""
    closed = log.where(F.col("pnl_realized").isNotNull() & (F.col("pnl_realized") != 0))
    w = Window.orderBy("timestamp").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return closed.select("timestamp", "pnl_realized",
                         F.sum(F.coalesce("pnl_realized", F.lit(0.0))).over(w).alias("cumulative_pnl"))


def recent_trades(log: DataFrame, n: int = 50) -> DataFrame:
    """SRV-6 / TOP-2: newest trades (ties by trade_id)."""
    return log.select(*TRADE_DISPLAY).orderBy(F.col("timestamp").desc(), F.col("trade_id").desc()).limit(n)


def recent_signals(signals: DataFrame, ticker: str, n: int = 30) -> DataFrame:
    """SRV-5 / TOP-5: the last ``n`` signals of one ticker, oldest first."""
    one = signals.where(F.col("ticker") == F.lit(ticker))
    cols = [c for c in SIGNAL_DISPLAY if c in signals.columns]
    last = one.orderBy(F.col("timestamp").desc(), F.col("signal").desc()).limit(n)
    return last.select(*cols).orderBy("timestamp", "signal")


def recent_indicators(ind: DataFrame, n: int = 15) -> DataFrame:
    """TOP-1: newest rows with an RSI value (ties by ticker)."""
    return ind.where(F.col("rsi").isNotNull()).orderBy(F.col("timestamp").desc(), "ticker").limit(n)


def signal_counts(signals: DataFrame) -> DataFrame:
    """AGG-6: signals per (ticker, label)."""
    return signals.groupBy("ticker", "signal").agg(F.count(F.lit(1)).alias("count"))


def layer_counts(**tables: DataFrame) -> DataFrame:
    """AGG-9 / SET-2: row count of each named table, as (tbl, rows)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows")
             for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def active_positions(portfolio: DataFrame) -> DataFrame:
    """SRV-9 / FLT-6 / TOP-6: open positions, missing numbers shown as 0, by ticker."""
    z = F.lit(0.0)
    return (portfolio.where(F.col("holdings") > 0)
            .select("ticker", "holdings",
                    F.coalesce("avg_entry_price", z).alias("avg_entry_price"),
                    F.coalesce("current_price", z).alias("current_price"),
                    F.coalesce("unrealized_pnl", z).alias("unrealized_pnl"),
                    F.coalesce("realized_pnl", z).alias("realized_pnl"),
                    F.coalesce("total_trades", F.lit(0)).alias("total_trades"))
            .orderBy("ticker"))


def chart_feed(bars: DataFrame, ind: DataFrame, signals: DataFrame, ticker: str) -> DataFrame:
    """SRV-2 / SRV-3: one ticker's bars with its indicators and signal markers aligned
    on time (left joins on (ticker, timestamp)); filters reach every scan."""
    key = ["ticker", "timestamp"]
    t = F.lit(ticker)
    b = bars.where(F.col("ticker") == t)
    i = ind.where(F.col("ticker") == t).select(*key, "sma20", "sma50", "rsi",
                                              "vortex_positive", "vortex_negative")
    s = signals.where(F.col("ticker") == t).select(
        *key, "signal", "signal_score", "stop_loss", "take_profit",
        annotation_text().alias("marker_text"))
    return b.join(i, key, "left").join(s, key, "left").orderBy("timestamp")


CHART_COLS = ["ticker", "timestamp", "open", "high", "low", "close", "volume", "sma20", "sma50",
              "rsi", "vortex_positive", "vortex_negative", "signal", "signal_score", "stop_loss",
              "take_profit", "marker_text"]


def chart_feed_from_bars(bars: DataFrame, ticker: str, p=None) -> DataFrame:
    """SRV-3 computed from bars alone in one pass: one scan, one window, the signal
    columns as CASE expressions on the same rows (no joins). Same rows as
    ``chart_feed`` over the derived indicator and signal tables."""
    from ..config import DEFAULT
    from ..functions import indicators as X
    from .indicators import indicators_chunked
    p = p or DEFAULT
    one = bars.where(F.col("ticker") == F.lit(ticker))
    ind = indicators_chunked(one, p, chunk_rows=p.chunk_rows, keep=("open", "high", "low", "volume"))
    label = F.when(X.buy_condition(p), "BUY").when(X.sell_condition(p), "SELL")
    lab = ind.withColumn("signal", label)
    has = F.col("signal").isNotNull()
    out = lab.select(
        *[F.col(c) for c in lab.columns],
        F.when(has, X.signal_score(p)).alias("signal_score"),
        F.when(has, X.stop_loss(p)).alias("stop_loss"),
        F.when(has, X.take_profit(p)).alias("take_profit"),
        F.when(has, annotation()).alias("marker_text"))
    return out.select(*CHART_COLS).orderBy("timestamp")


def annotation_text() -> Column:
    """SIG-7 marker text with display rounding applied first (engine independent)."""
    return annotation()
