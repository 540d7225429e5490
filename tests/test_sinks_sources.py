"""Sinks (batch-keyed append, reset) and source helpers (vendor decode, ticker scan)."""

import pytest
from pyspark.sql import functions as F

from barwise import schemas
from barwise.operators import sinks as K
from barwise.operators import versions as VT
from barwise.session import scratch_path
from barwise.sources import adapters as A
from barwise.sources import tables as TB
from barwise.sources import vendor as VD

from helpers import bars_df


def test_append_batch_is_idempotent_and_reset_keeps_logs(spark):
    root = scratch_path(spark, "tables")
    b = bars_df(spark, [1.0, 2.0, 3.0])
    K.append_batch(b, root, "trade_signals", 0)
    K.append_batch(b, root, "trade_signals", 0)      # retry of the same batch
    K.append_batch(b, root, "trade_signals", 1)
    assert K.read_layer(spark, root, "trade_signals").count() == 6
    with pytest.raises(ValueError):                  # bars are upserted, not appended
        K.append_batch(b, root, "raw_market_data", 0)
    VT.merge(spark, K.table_path(root, "raw_market_data"), b, schemas.BAR_KEY)
    assert K.read_layer(spark, root, "raw_market_data").count() == 3
    log = spark.createDataFrame([("X", "BUY")], "ticker string, signal string")
    K.append_batch(log, root, "trade_log", 0)
    K.reset_layers(spark, root, confirm=True)
    assert K.read_layer(spark, root, "raw_market_data").count() == 0
    assert K.read_layer(spark, root, "trade_signals").count() == 0
    assert K.read_layer(spark, root, "trade_log").count() == 1
    assert K.read_layer(spark, root, "trade_log").schema == schemas.TRADE_LOG


def test_conform_adds_typed_nulls(spark):
    df = spark.createDataFrame([("A", 1.0)], "ticker string, close double")
    out = schemas.conform(df, schemas.SIGNALS)
    assert out.schema == schemas.SIGNALS
    assert out.first()["stop_loss"] is None


def test_vendor_decode_bad_value_is_null(spark, sf_dir):
    bars = VD.conform_vendor(A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir))
    assert bars.schema == schemas.BARS
    assert bars.where(F.col("close").isNull()).count() > 0
    missing = VD.missing_sources(A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir)).collect()
    assert [r["ticker"] for r in missing] == [A.ABSENT_SYMBOL]


def test_ticker_scan_pushes_filters(spark):
    path = scratch_path(spark, "bars")
    bars_df(spark, [1.0, 2.0]).write.parquet(path)
    df = TB.scan_ticker(spark.read.parquet(path), "T", not_null="close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ticker), IsNotNull(close), EqualTo(ticker,T)]" in plan or \
           ("EqualTo(ticker,T)" in plan and "IsNotNull(close)" in plan)
    assert df.count() == 2


def test_csv_landing_zone_conforms_like_parquet(spark, sf_dir):
    """SRC-1: a CSV landing zone read with a declared schema gives the same bars."""
    raw = A.vendor_bars(spark, sf_dir)
    path = scratch_path(spark, "vendor-csv")
    raw.write.option("header", True).csv(path)
    landed = TB.read_bars(spark, path, VD.VENDOR_RAW, fmt="csv", header=True,
                          timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    a = VD.conform_vendor(landed, A.symbol_dim(spark, sf_dir))
    b = VD.conform_vendor(raw, A.symbol_dim(spark, sf_dir))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_event_marks_and_unknown_type(spark):
    from barwise.operators import quality as Q
    df = spark.createDataFrame([("GAP_DETECTED",), ("OHLC_INCONSISTENCY",), ("API_ERROR",)], "event_type string")
    marks = {r["event_type"]: r["m"] for r in df.select("event_type", Q.event_mark().alias("m")).collect()}
    assert marks == {"GAP_DETECTED": "G", "OHLC_INCONSISTENCY": "?", "API_ERROR": "X"}


def test_broadcast_needs_a_checked_size(spark):
    from barwise.functions.broadcast import checked_broadcast
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "ticker string, close double")
    hinted = checked_broadcast(df, max_rows=3)
    plan = hinted.join(df, "ticker")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert checked_broadcast(df, max_rows=2) is df


def test_rows_of_strings_are_typed_by_their_manifest(spark):
    rows = spark.createDataFrame([(["7", "2.5", "2024-01-02 03:04:05", "x"],), (["seven", None, "soon"],), ([],), (None,)],
                                 "cells array<string>")
    manifest = spark.createDataFrame([(1, "b", "DOUBLE"), (0, "a", "INT"), (2, "t", "TIMESTAMP_NTZ"), (9, "z", "DECIMAL(9,2)")],
                                     "position int, name string, type string")
    out = VD.decode_rows(rows, manifest)
    assert [t for _, t in out.dtypes] == ["int", "double", "timestamp_ntz", "decimal(9,2)"]
    got = [tuple(r) for r in out.collect()]
    assert got[0][:2] == (7, 2.5) and got[0][2].isoformat() == "2024-01-02T03:04:05" and got[0][3] is None
    assert got[1:] == [(None, None, None, None)] * 3
