"""Versioned tables: whole versions, refused writers, changes, derived statistics."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from barwise import schemas
from barwise.operators import bar_stats as BS
from barwise.operators import indicators as IND
from barwise.operators import quality as Q
from barwise.operators import versions as VT
from barwise.plans.output import round_doubles
from barwise.session import scratch_path
from barwise.sources import adapters as A
from barwise.streaming import jobs as J

from helpers import T0, bars_df

KEY = schemas.BAR_KEY


def days(spark, n, close=1.0, ticker="T", first=0):
    """One bar on each of n days."""
    return bars_df(spark, [close] * n, ticker=ticker, step_min=24 * 60, start=T0 + dt.timedelta(days=first))


def rows(df):
    return sorted((r["ticker"], r["timestamp"], r["close"]) for r in df.collect())


def test_a_reader_sees_whole_versions_only(spark):
    path = scratch_path(spark, "table")
    assert VT.read(spark, path, schemas.BARS).count() == 0
    VT.merge(spark, path, days(spark, 6), KEY)
    reader = VT.read(spark, path, schemas.BARS)
    old = rows(reader)
    staged = VT.stage(spark, path, days(spark, 4, 2.0).unionByName(days(spark, 1, 2.0, first=9)), KEY)
    assert (staged.inserted, staged.updated) == (1, 4)
    assert rows(VT.read(spark, path, schemas.BARS)) == old           # half of the write is done
    VT.publish(spark, staged)
    new = rows(VT.read(spark, path, schemas.BARS))
    assert [c for *_, c in new] == [2.0] * 4 + [1.0] * 2 + [2.0]
    assert rows(reader) == old and rows(VT.read(spark, path, schemas.BARS, 1)) == old
    assert VT.versions(spark, path) == [1, 2]
    VT.rolled_back(spark, path, 1)
    assert rows(VT.read(spark, path, schemas.BARS)) == old


def test_of_two_writers_on_one_date_one_is_refused(spark):
    path = scratch_path(spark, "table")
    VT.merge(spark, path, days(spark, 3), KEY)
    one = VT.stage(spark, path, days(spark, 1, 5.0), KEY)
    two = VT.stage(spark, path, days(spark, 2, 7.0), KEY)
    VT.publish(spark, one)
    with pytest.raises(VT.CommitConflict):
        VT.publish(spark, two)
    assert [c for *_, c in rows(VT.read(spark, path, schemas.BARS))] == [5.0, 1.0, 1.0]
    # on other dates the files stay right and only the manifest is rebuilt
    three = VT.stage(spark, path, days(spark, 1, 9.0, first=2), KEY)
    VT.merge(spark, path, days(spark, 1, 6.0), KEY)
    assert VT.publish(spark, three).version == 4
    assert [c for *_, c in rows(VT.read(spark, path, schemas.BARS))] == [6.0, 1.0, 9.0]


def test_writers_at_the_same_time_lose_nothing(spark):
    path = scratch_path(spark, "table")
    sources = [days(spark, 2, float(i), ticker=f"T{i}") for i in range(3)]
    threads = [threading.Thread(target=VT.merge, args=(spark, path, s, KEY, 10)) for s in sources]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(rows(VT.read(spark, path, schemas.BARS))) == 6 and VT.versions(spark, path) == [1, 2, 3]


def test_changes_and_deletes(spark):
    path = scratch_path(spark, "table")
    VT.merge(spark, path, days(spark, 5), KEY)
    first = T0.date()
    VT.merge(spark, path, days(spark, 2, 3.0).unionByName(days(spark, 1, 1.0, first=2)), KEY)
    gone = VT.merge(spark, path, days(spark, 1, 4.0, first=7), KEY, remove=days(spark, 2, first=3))
    assert (gone.inserted, gone.deleted) == (1, 2)
    found = VT.changes(spark, path, schemas.BARS, KEY, 1, 2).collect()
    assert sorted(((r.timestamp.date() - first).days, r.change, r.close) for r in found) \
        == [(0, "update", 3.0), (1, "update", 3.0)]                   # the third row was written, not changed
    found = VT.changes(spark, path, schemas.BARS, KEY, 2).collect()
    assert sorted(((r.timestamp.date() - first).days, r.change, r.close, r.version) for r in found) \
        == [(3, "delete", 1.0, 3), (4, "delete", 1.0, 3), (7, "insert", 4.0, 3)]
    assert VT.changes(spark, path, schemas.BARS, KEY, 3, 3).count() == 0
    VT.vacuum(spark, path, 1)
    assert VT.versions(spark, path) == [3] and len(rows(VT.read(spark, path, schemas.BARS))) == 4
    VT.clear(spark, path)
    assert VT.read(spark, path, schemas.BARS).count() == 0
    assert VT.changes(spark, path, schemas.BARS, KEY, 3).groupBy("change").count().collect() == [("delete", 4)]


def test_a_stream_over_a_rewritten_table_equals_the_batch(spark):
    bars, feed, ind, ckpt = (scratch_path(spark, x) for x in ("bars", "feed", "ind", "ckpt"))

    def in_step():
        J.run_corrections(spark, bars, feed, ind, ckpt)
        stored = VT.read(spark, bars, schemas.BARS)
        got, want = (round_doubles(x) for x in (VT.read(spark, ind, schemas.INDICATORS), IND.indicators(stored)))
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
        return got

    closes = [100.0 + i * 7 % 13 for i in range(240)]
    both = bars_df(spark, closes, "A").unionByName(bars_df(spark, closes[::-1], "B"))
    VT.merge(spark, bars, both, KEY)
    in_step()
    before = VT.manifest(spark, ind).version
    VT.merge(spark, bars, bars_df(spark, [50.0], "A", start=T0 + dt.timedelta(minutes=300)), KEY)        # an old bar
    VT.merge(spark, bars, bars_df(spark, [90.0] * 5, "B", start=T0 + dt.timedelta(minutes=2400)), KEY)   # new ones
    in_step()
    VT.merge(spark, bars, None, KEY, remove=both.where("ticker = 'B'").limit(30), schema=schemas.BARS)
    VT.merge(spark, bars, bars_df(spark, [1.0], "C"), KEY)
    in_step()
    VT.merge(spark, bars, None, KEY, remove=VT.read(spark, bars, schemas.BARS).where("ticker = 'A'"), schema=schemas.BARS)
    assert in_step().where("ticker = 'A'").count() == 0
    again = VT.manifest(spark, ind).version
    J.run_corrections(spark, bars, feed, ind, ckpt)                     # nothing changed, nothing is written
    assert VT.manifest(spark, ind).version == again > before


def test_statistics_stay_in_step_and_read_only_touched_dates(spark):
    bars, stats = scratch_path(spark, "bars"), scratch_path(spark, "stats")

    def equal():
        BS.refresh(spark, bars, stats)
        stored, made = VT.read(spark, bars, schemas.BARS), BS.read(spark, stats)
        for a, b in ((Q.bar_profile(stored), BS.bar_profile(made)),
                     (Q.union_events(Q.low_bar_count(stored), Q.freshness(stored, A.as_of_lit()), Q.duplicate_events(stored)),
                      BS.checks(made, A.as_of_lit()))):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
        assert BS.row_count(made, "bars").first()["rows"] == stored.count()

    VT.merge(spark, bars, days(spark, 30).unionByName(bars_df(spark, [1.0] * 700, "M")), KEY)
    equal()
    first = VT.manifest(spark, stats)
    VT.merge(spark, bars, days(spark, 1, 2.0, first=20).unionByName(days(spark, 1, 2.0, first=40)), KEY)
    equal()
    second = VT.manifest(spark, stats)
    assert sum(first.parts.get(d) != c for d, c in second.parts.items()) == 2
    assert BS.refresh(spark, bars, stats).version == second.version
    VT.merge(spark, bars, None, KEY, remove=days(spark, 3, first=19), schema=schemas.BARS)
    equal()
    VT.clear(spark, bars)
    equal()
    assert BS.read(spark, stats).count() == 0
    VT.merge(spark, bars, days(spark, 2).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), KEY)
    BS.refresh(spark, bars, stats)
    assert BS.row_count(BS.read(spark, stats), "bars").first()["rows"] >= 1


def test_one_ticker_reads_only_its_bucket(spark, sf_dir):
    path = scratch_path(spark, "bucketed")
    bars = A.bars_10m(spark, sf_dir)
    VT.merge(spark, path, bars, KEY, buckets=4)
    one_day = bars.where(F.to_date("timestamp") == F.lit(A.REDELIVERED_DAY).cast("date"))
    VT.merge(spark, path, one_day.withColumn("close", F.col("close") + 1), KEY)      # the layout stays
    for ticker in [r[0] for r in bars.select("ticker").distinct().collect()]:
        got = VT.read_key(spark, path, schemas.BARS, ticker)
        assert rows(got) == rows(VT.read(spark, path, schemas.BARS).where(F.col("ticker") == ticker))
        folders = {r[0].split("_bucket=")[1].split("/")[0] for r in got.select(F.input_file_name()).distinct().collect()}
        assert len(folders) == 1
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert VT.read_key(spark, path, schemas.BARS, "none").count() == 0
    VT.clear(spark, path)
    VT.merge(spark, path, one_day, KEY)
    assert VT.manifest(spark, path).buckets == 4
    plain = scratch_path(spark, "plain")
    VT.merge(spark, plain, one_day, KEY)
    with pytest.raises(ValueError):
        VT.read_key(spark, plain, schemas.BARS, "view")
