"""Stream/batch parity, late bars, restart from checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from barwise import schemas
from barwise.operators import indicators as IND
from barwise.plans.output import round_doubles
from barwise.session import scratch_path
from barwise.sources import adapters as A
from barwise.streaming import jobs as J

from helpers import T0, bars_df


def test_parity_any_split(spark, sf_dir):
    bars = A.bars_1h(spark, sf_dir)
    batch = round_doubles(IND.indicators(bars))
    for k in (1, 3):
        landing = scratch_path(spark, "land")
        files = J.land_in_time_order(bars, landing, k)
        out = scratch_path(spark, "out")
        sinks = J.run_indicator_stream(spark, landing, out, max_files=files, cooldown=False)
        assert len(sinks.metrics) == k
        silver = round_doubles(J.read_output(spark, out, "silver"))
        assert silver.count() == batch.count() and silver.exceptAll(batch).count() == 0


def test_late_bar_and_restart(spark):
    landing = scratch_path(spark, "land")
    out = scratch_path(spark, "out")
    ckpt = scratch_path(spark, "ckpt")
    first = bars_df(spark, [float(i) for i in range(1, 31)])
    first.repartition(1).write.mode("append").parquet(landing)
    J.run_indicator_stream(spark, landing, out, checkpoint=ckpt, cooldown=False)
    # second delivery: one bar older than state, then new bars; restart from the checkpoint
    late = bars_df(spark, [99.0], start=T0 + dt.timedelta(minutes=5))
    more = bars_df(spark, [float(i) for i in range(31, 41)], start=T0 + dt.timedelta(minutes=300))
    late.unionByName(more).repartition(1).write.mode("append").parquet(landing)
    sinks = J.run_indicator_stream(spark, landing, out, checkpoint=ckpt, cooldown=False)
    assert [m["batch_id"] for m in sinks.metrics] == [1]
    lates = J.read_output(spark, out, "late").collect()
    assert [r["close"] for r in lates] == [99.0]
    silver = J.read_output(spark, out, "silver")
    assert silver.count() == 40
    expect = IND.indicators(first.unionByName(more))
    assert round_doubles(silver).exceptAll(round_doubles(expect)).count() == 0
    # the late bar is repaired by recomputing its ticker over the full bar table
    all_bars = first.unionByName(late).unionByName(more)
    fixed = round_doubles(J.corrected_indicators(spark, out, all_bars))
    assert fixed.count() == 41
    assert fixed.exceptAll(round_doubles(IND.indicators(all_bars))).count() == 0


def test_processing_time_trigger(spark):
    """STR-4: the same stream with a processing-time trigger, stopped after one drain."""
    landing = scratch_path(spark, "land")
    bars_df(spark, [float(i) for i in range(1, 26)]).repartition(1).write.parquet(landing)
    out = scratch_path(spark, "out")
    sinks = J.BatchSinks(out, cooldown=False)
    q = (J.indicator_stream(J.bar_stream(spark, landing))
         .writeStream.foreachBatch(sinks).option("checkpointLocation", f"{out}/_ckpt")
         .trigger(processingTime="1 second").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert J.read_output(spark, out, "silver").count() == 25


def test_cooldown_across_batches(spark):
    """Batch 2 candidates within 1800 s of the latest signal stored by batch 1 (same
    label) are dropped; candidates inside one batch never suppress each other."""
    import math
    from barwise.operators import signals as SIG
    closes = [100 + 8 * math.sin(i / 6.0) + (i % 3) * 0.3 for i in range(160)]
    b = bars_df(spark, closes)
    landing = scratch_path(spark, "land")
    files = J.land_in_time_order(b, landing, 2)
    out = scratch_path(spark, "out")
    J.run_indicator_stream(spark, landing, out, max_files=files, cooldown=True)
    gold = sorted((r["timestamp"], r["signal"]) for r in J.read_output(spark, out, "gold").collect())
    allsig = sorted((r["timestamp"], r["signal"]) for r in SIG.signals(IND.indicators(b)).collect())
    split = T0 + (T0 + dt.timedelta(minutes=10 * 159) - T0) / 2
    first = [x for x in allsig if x[0] < split]
    last = {}
    for t, lab in first:
        last[lab] = max(last.get(lab, t), t)
    expect = first + [(t, lab) for t, lab in allsig if t >= split
                      and (lab not in last or (t - last[lab]).total_seconds() > 1800)]
    assert len(allsig) > len(expect) > 0
    assert gold == sorted(expect)


def test_state_partitions_option(spark):
    landing = scratch_path(spark, "land")
    bars_df(spark, [float(i) for i in range(1, 21)]).repartition(1).write.parquet(landing)
    out = scratch_path(spark, "out")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    J.run_indicator_stream(spark, landing, out, cooldown=False, state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert J.read_output(spark, out, "silver").count() == 20


def test_empty_batches_do_not_reset_the_cooldown(spark, sf_dir):
    bars = A.bars_10m(spark, sf_dir)
    counts = []
    for empty_after in (None, 0):
        landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
        J.land_in_time_order(bars, landing, 2, empty_after=empty_after)
        J.run_indicator_stream(spark, landing, out, max_files=1, cooldown=True)
        counts.append(J.read_output(spark, out, "gold").count())
    assert counts[0] == counts[1]


def test_dedup_drops_repeats_and_finds_new_late_bars(spark):
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    bars = bars_df(spark, [float(i) for i in range(1, 91)])
    new_late = bars_df(spark, [7.5], start=T0 + dt.timedelta(minutes=5))
    J.land_in_time_order(bars, landing, 3, repeat_last="1 hour")
    new_late.coalesce(1).write.mode("append").parquet(landing)
    q = J.run_to_parquet(J.stream_dedup(J.bar_stream(spark, landing, 1), "2 hours"), out)
    dropped = sum(op["customMetrics"]["numDroppedDuplicateRows"]
                  for p in q.recentProgress for op in p["stateOperators"])
    assert dropped > 0
    kept = spark.read.parquet(out)
    assert kept.count() == 90
    late = J.late_new_bars(kept, spark.read.schema(schemas.BARS).parquet(landing)).collect()
    assert [r["close"] for r in late] == [7.5]


def test_null_closes_are_skipped_alike_in_batch_and_stream(spark):
    closes = [100 + (i * 7 % 13) for i in range(90)]
    for i in (30, 31, 64):
        closes[i] = None
    bars = bars_df(spark, [None if c is None else float(c) for c in closes])
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    J.land_in_time_order(bars, landing, 3)
    J.run_indicator_stream(spark, landing, out, max_files=1, cooldown=False)
    got, want = (round_doubles(x) for x in (J.read_output(spark, out, "silver"), IND.indicators(bars)))
    assert got.count() == 90 and got.exceptAll(want).count() == 0
    assert want.where("sma20 is not null and sma50 is not null").count() > 30


def test_state_follows_the_windows(spark):
    import pytest
    from barwise.config import DEFAULT
    p = DEFAULT.with_(sma_long=100)
    bars = bars_df(spark, [100.0 + i % 17 for i in range(220)])
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    J.land_in_time_order(bars, landing, 4)
    J.run_indicator_stream(spark, landing, out, p, max_files=1, cooldown=False)
    got, want = (round_doubles(x) for x in (J.read_output(spark, out, "silver"), IND.indicators(bars, p)))
    assert got.exceptAll(want).count() == 0 and want.where("sma50 is not null").count() == 121
    with pytest.raises(ValueError):
        J.RollingIndicatorProcessor(p.with_(tail_cap=55))


def _same(got, want):
    got, want = round_doubles(got), round_doubles(want)
    return got.count() == want.count() and got.exceptAll(want).count() == 0


def test_late_bars_are_put_in_order_within_the_watermark(spark):
    import random
    rng = random.Random(3)
    a = bars_df(spark, [100 + (i * 7 % 13) / 2 for i in range(200)], "A")
    b = bars_df(spark, [50 + (i * 5 % 17) / 2 for i in range(150)], "B", start=T0 + dt.timedelta(minutes=5))
    bars = a.unionByName(b)
    rows = sorted(bars.collect(), key=lambda r: (r["timestamp"] + dt.timedelta(minutes=rng.randint(0, 110)), r["ticker"]))
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i:i + 60], schemas.BARS).coalesce(1).write.mode("append").parquet(landing)
    J.run_indicator_stream(spark, landing, out, max_files=1, cooldown=False, late_delay="2 hours")
    so_far = J.read_output(spark, out, "silver").count()
    assert 0 < so_far < 350                                  # the newest wait for the watermark
    J.land_close(spark, landing, "2 hours")
    J.run_indicator_stream(spark, landing, out, max_files=1, cooldown=False, late_delay="2 hours")
    assert _same(J.read_output(spark, out, "silver"), IND.indicators(bars))
    assert J.read_output(spark, out, "late").count() == 0


def test_one_hot_ticker_in_one_micro_batch(spark):
    """400,000 bars of a ticker in a micro-batch, spread over tasks; late and repeated bars."""
    from barwise.config import DEFAULT
    p = DEFAULT.with_(chunk_rows=20_000, order_bucket="hour")
    t = F.timestamp_add("SECOND", F.col("id") * 10, F.lit(T0).cast("timestamp_ntz"))
    wave = F.sin(F.col("id") / 9) * 8 + 100 + F.col("id") % 5
    bars = schemas.conform(spark.range(400_000).select(
        F.lit("HOT").alias("ticker"), t.alias("timestamp"), wave.alias("open"), (wave + 1).alias("high"),
        (wave - 1).alias("low"), wave.alias("close"), F.lit(1).alias("volume")), schemas.BARS)
    other = bars_df(spark, [float(i % 9 + 1) for i in range(70)], "COLD")
    split = F.lit(T0 + dt.timedelta(minutes=60000)).cast("timestamp_ntz")
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    J.land(bars.where(F.col("timestamp") < split).unionByName(other.limit(40)), landing, 4)
    J.run_chunked_stream(spark, landing, out, p, cooldown=False)
    rest = bars.where(F.col("timestamp") >= split)
    J.land(rest.unionByName(other.exceptAll(other.limit(40))).unionByName(rest.limit(3)), landing, 4)
    J.land(bars.limit(2), landing, 1)
    J.run_chunked_stream(spark, landing, out, p, cooldown=False)
    both = bars.unionByName(other)
    assert _same(J.read_output(spark, out, "silver"), IND.indicators_chunked(both, p, p.chunk_rows))
    assert J.read_output(spark, out, "late").count() == 5
    sinks = J.ChunkedSinks(out, p)
    plan = sinks.indicators(spark.read.schema(schemas.BARS).parquet(landing), 9)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def test_a_repeated_micro_batch_leaves_the_same_state(spark):
    from barwise.session import child_versions
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    bars = bars_df(spark, [100 + (i * 7 % 13) / 2 for i in range(120)])
    J.land_in_time_order(bars, landing, 4)
    J.run_chunked_stream(spark, landing, out, max_files=1)
    assert child_versions(spark, f"{out}/tail") == [2, 3] and len(child_versions(spark, f"{out}/cooldown")) <= 2
    sinks = J.ChunkedSinks(out)
    newest = bars.where(F.col("timestamp") >= J.read_output(spark, out, "silver").agg(F.max("timestamp")).first()[0]
                        - dt.timedelta(minutes=290))
    before = sorted(spark.read.parquet(f"{out}/tail/v=3").collect())
    sinks(newest, 3)
    assert sorted(spark.read.parquet(f"{out}/tail/v=3").collect()) == before
    assert _same(J.read_output(spark, out, "silver"), IND.indicators(bars))


def test_state_read_back_and_changed_windows_refused(spark):
    import pytest
    from barwise.config import DEFAULT
    landing, out = scratch_path(spark, "land"), scratch_path(spark, "out")
    bars_df(spark, [float(i) for i in range(1, 81)], "A").unionByName(bars_df(spark, [1.0] * 7, "B")) \
        .write.mode("append").parquet(landing)
    J.run_indicator_stream(spark, landing, out, cooldown=False)
    bars_df(spark, [5.0], "B", start=T0 + dt.timedelta(minutes=900)).write.mode("append").parquet(landing)
    J.run_indicator_stream(spark, landing, out, cooldown=False)
    got = {r["ticker"]: r for r in J.stored_state(spark, f"{out}/_checkpoint").collect()}
    assert (got["A"]["bars_seen"], got["A"]["bars_kept"]) == (80, DEFAULT.state_rows)
    assert got["A"]["newest"] == T0 + dt.timedelta(minutes=790)
    assert (got["B"]["bars_seen"], got["B"]["bars_kept"]) == (8, 8)
    assert got["B"]["oldest_kept"] == T0 and got["B"]["newest"] == T0 + dt.timedelta(minutes=900)
    with pytest.raises(ValueError, match="sma_long"):
        J.run_indicator_stream(spark, landing, out, DEFAULT.with_(sma_long=30), cooldown=False)


class _Entries(dict):
    """A map state without a stream."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_one_call_takes_a_group_of_tickers(spark):
    import pandas as pd
    import pytest
    from barwise.config import DEFAULT
    state = _Entries()
    handle = type("Handle", (), {"getMapState": lambda self, *a: state})()
    proc = J.RollingIndicatorProcessor()
    proc.init(handle)
    lengths = {"A": 75, "B": 9, "C": 52, None: 30}
    bars = pd.DataFrame([(t, T0 + dt.timedelta(minutes=i), 3.0 + (i * k) % 7, 1.0 + (i + k) % 2, 2.0 + (i * k) % 5)
                         for k, (t, n) in enumerate(lengths.items(), 1) for i in range(n)],
                        columns=["ticker", "timestamp", "high", "low", "close"])
    bars.loc[20, "close"] = None
    early = bars.groupby("ticker", dropna=False).cumcount() < 8
    got = []
    for part in (bars[early], pd.concat([bars[~early], bars[bars.ticker == "B"].tail(1)]), bars[early & (bars.ticker == "A")]):
        shuffled = part.sample(frac=1, random_state=1)
        got += proc.handleInputRows((0,), iter([shuffled.iloc[:50], shuffled.iloc[50:]]), None)
    got = pd.concat(got)
    late = got[got.is_late]
    assert sorted(late.ticker) == ["A"] * 8 + ["B"] and late.sma20.isna().all()
    assert {t[0]: v[4] for t, v in state.items()} == lengths
    assert all(len(v[0]) == min(lengths[t[0]], DEFAULT.state_rows) for t, v in state.items())
    typed = [(None if pd.isna(r.ticker) else r.ticker, r.timestamp.to_pydatetime(), r.high, r.low,
              None if pd.isna(r.close) else r.close) for r in bars.itertuples()]
    want = IND.indicators(spark.createDataFrame(typed, "ticker string, timestamp timestamp_ntz, high double, low double, close double"))
    want = {(r["ticker"], r["timestamp"]): tuple(r)[2:] for r in want.collect()}
    fresh = got[~got.is_late]
    assert len(fresh) == len(want)
    for r in fresh.itertuples(index=False):
        expect = want[None if pd.isna(r.ticker) else r.ticker, r.timestamp.to_pydatetime()]
        assert [None if pd.isna(x) else x for x in r[2:8]] == [x if x is None else pytest.approx(x, abs=1e-9) for x in expect]
