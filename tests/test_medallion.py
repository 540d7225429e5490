"""End-to-end batch runs over the table layout, run twice."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwise import schemas
from barwise.operators import indicators as IND
from barwise.operators import sinks as K
from barwise.operators import versions as VT
from barwise.plans import medallion as M
from barwise.plans.output import round_doubles
from barwise.session import scratch_path
from barwise.sources import adapters as A
from barwise.sources import vendor as VD

from helpers import T0


def test_runs_end_to_end_and_rerun_is_stable(spark, sf_dir):
    root = scratch_path(spark, "layers")
    raw, dim = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir)
    asof = A.as_of_lit()
    ev1 = M.ingest_bars(spark, raw, dim, root, 1, asof).count()
    bars1 = K.read_layer(spark, root, "raw_market_data").count()
    M.quality_checks(spark, root, 1, asof)
    sig1 = M.refresh_signals(spark, root, 1).count()
    port1, rows1 = M.refresh_portfolio(spark, root, 1, asof)
    assert bars1 > 0 and ev1 > 0 and sig1 > 0 and port1.count() == 5
    assert rows1.count() > 0

    # second ingest of the same landing data: every bar is an update, nothing new
    ev2 = M.ingest_bars(spark, raw, dim, root, 2, asof)
    assert K.read_layer(spark, root, "raw_market_data").count() == bars1
    dup = ev2.where(F.col("event_type") == "DUPLICATE_DETECTED").first()
    assert dup["bar_count"] == bars1
    assert M.refresh_signals(spark, root, 2).count() == 0
    _, rows2 = M.refresh_portfolio(spark, root, 2, asof)
    assert rows2.where(F.col("signal").isin("BUY", "SELL")).count() == 0
    assert K.read_layer(spark, root, "trade_signals").count() == sig1


def test_events_kept_when_every_symbol_fails(spark, sf_dir):
    """All bars rejected: no bars are written, the DQ events still are."""
    root = scratch_path(spark, "layers")
    raw = A.vendor_bars(spark, sf_dir).withColumn("Low", F.lit("-1"))
    log = M.ingest_bars(spark, raw, A.symbol_dim(spark, sf_dir), root, 1, A.as_of_lit())
    types = {r["event_type"] for r in log.collect()}
    assert "INVALID_PRICE" in types and "MISSING_BARS" in types
    assert K.read_layer(spark, root, "raw_market_data").count() == 0


def _tables(spark, root):
    return {name: sorted(map(str, K.read_layer(spark, root, name).collect()))
            for name in K.LAYERS if name != "portfolio_state"} \
        | {"portfolio_state": sorted(map(str, K.read_version(spark, root, "portfolio_state").collect()))}


def test_every_step_can_be_repeated_with_its_run_id(spark, sf_dir):
    root = scratch_path(spark, "layers")
    raw, dim, asof = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir), A.as_of_lit()
    half = F.col("Datetime") < F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    steps = [lambda r, i: M.ingest_bars(spark, r, dim, root, i, asof), lambda r, i: M.quality_checks(spark, root, i, asof),
             lambda r, i: M.refresh_signals(spark, root, i), lambda r, i: M.refresh_portfolio(spark, root, i, asof)]
    for run, landed in ((1, raw.where(half)), (2, raw)):
        for step in steps:
            step(landed, run)
            once = _tables(spark, root)
            step(landed, run)
            assert _tables(spark, root) == once
    assert len(once["trade_signals"]) > 50 and len(once["trade_log"]) >= 5


def test_incremental_refresh_equals_a_full_one(spark, sf_dir):
    root, full = scratch_path(spark, "layers"), scratch_path(spark, "layers")
    raw, dim, asof = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir), A.as_of_lit()
    split = F.lit(A.SPLIT_TS).cast("timestamp_ntz")
    for run, landed in ((1, raw.where(F.col("Datetime") < split)), (2, raw.where(F.col("Datetime") >= split))):
        M.ingest_bars(spark, landed, dim, root, run, asof)
        M.refresh_signals(spark, root, run)
    bars = K.read_layer(spark, root, "raw_market_data")
    got = K.read_layer(spark, root, "technical_indicators")
    want = IND.indicators(bars)
    assert got.count() == want.count()
    assert round_doubles(got).exceptAll(round_doubles(want)).count() == 0
    touched = K.run_fact(spark, root, "touched", 2, M.TOUCHED)
    assert touched.agg(F.min("first_new") >= split).first()[0]


def test_ingest_and_quality_events_do_not_share_a_batch(spark, sf_dir):
    root, asof = scratch_path(spark, "layers"), A.as_of_lit()
    raw, dim = A.vendor_bars(spark, sf_dir), A.symbol_dim(spark, sf_dir)
    n = M.ingest_bars(spark, raw, dim, root, 10_000_001, asof).count()
    m = M.quality_checks(spark, root, 1, asof).count()
    assert K.read_layer(spark, root, "data_quality_events").count() == n + m


def test_undecoded_times_and_unmapped_symbols_are_reported(spark, sf_dir):
    root = scratch_path(spark, "layers")
    raw = A.vendor_bars(spark, sf_dir).withColumn("Datetime", F.col("Datetime").cast("string"))
    bad = raw.limit(3).withColumn("Datetime", F.lit("soon"))
    alien = raw.limit(2).withColumn("symbol", F.lit("ALIEN"))
    nameless = raw.limit(1).withColumn("symbol", F.lit(None).cast("string"))
    log = M.ingest_bars(spark, raw.union(bad).union(alien).union(nameless), A.symbol_dim(spark, sf_dir), root, 1,
                        A.as_of_lit()).where(F.col("event_type").isin("UNDECODED_TIME", "UNMAPPED_SYMBOL"))
    got = sorted((r["event_type"], r["ticker"], r["bar_count"]) for r in log.collect())
    assert sum(n for t, _, n in got if t == "UNDECODED_TIME") == 3
    assert [x[1:] for x in got if x[0] == "UNMAPPED_SYMBOL"] == [("<none>", 1), ("ALIEN", 2)]


def test_only_an_absent_path_is_an_absent_table(spark):
    root = scratch_path(spark, "layers")
    assert K.read_layer(spark, root, "trade_log").count() == 0
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.text(f"{root}/trade_log/batch_id=1")
    with pytest.raises(Exception):
        K.read_layer(spark, root, "trade_log").collect()


def test_first_upsert_keeps_the_last_delivered_row(spark):
    path = scratch_path(spark, "bars")
    row = "ticker string, timestamp timestamp_ntz, close double, seq int"
    t = T0
    first = spark.createDataFrame([("A", t, 9.0, 1), ("A", t, 5.0, 2), ("B", t, 1.0, 1)], row)
    one = VT.merge(spark, path, first, ["ticker", "timestamp"], order="seq")
    assert (one.inserted, one.updated) == (2, 0)
    more = spark.createDataFrame([("B", t, 3.0, 9), ("B", t, 8.0, 4), ("C", t, 2.0, 1)], row)
    two = VT.merge(spark, path, more, ["ticker", "timestamp"], order="seq")
    assert (two.inserted, two.updated) == (1, 1)
    schema = T.StructType([f for f in first.schema.fields if f.name != "seq"])
    got = {r["ticker"]: r["close"] for r in VT.read(spark, path, schema).collect()}
    assert got == {"A": 5.0, "B": 3.0, "C": 2.0}


def test_upsert_reads_and_writes_only_the_touched_dates(spark, sf_dir):
    path = scratch_path(spark, "bars")
    bars = A.bars_10m(spark, sf_dir)
    before = VT.merge(spark, path, bars, schemas.BAR_KEY)
    one_day = bars.where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    staged = VT.stage(spark, path, one_day, schemas.BAR_KEY)
    assert list(staged.parts) == [str(A.REDELIVERED_DAY)[:10]]
    assert staged.inserted == 0 and staged.updated == one_day.count()
    after = VT.publish(spark, staged)
    assert {d for d in after.parts if after.parts[d] != before.parts[d]} == set(staged.parts)
    stored = VT.read(spark, path, T.StructType([*schemas.BARS.fields, T.StructField("date", T.DateType())])) \
        .where(F.col("date") == F.lit(A.REDELIVERED_DAY).cast("date"))
    assert re.search(r"PartitionFilters: \[[^\]]*date", stored._jdf.queryExecution().executedPlan().toString())


def test_landed_rows_are_not_shuffled_on_the_symbol(spark, sf_dir):
    path = scratch_path(spark, "landed")
    A.vendor_bars(spark, sf_dir).write.parquet(path)
    dim = A.symbol_dim(spark, sf_dir)
    plan = VD.conform_vendor(spark.read.parquet(path), dim)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    missing = VD.missing_sources(spark.read.parquet(path), dim)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in missing
