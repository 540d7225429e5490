"""Circuit-breaker rules in order, spike handling, data-quality events."""

import datetime as dt

from pyspark.sql import functions as F

from barwise import schemas
from barwise.operators import quality as Q
from barwise.operators import validate as V
from barwise.sources import adapters as A

from helpers import T0, bars_df


def _bar(i, o, h, lo, c, v=1, ticker="B"):
    return (ticker, T0 + dt.timedelta(minutes=10 * i), o, h, lo, c, v)


def test_bad_prices_each_rule_in_order(spark):
    rows = [_bar(0, 1.0, 2.0, 0.5, float("nan")),      # NaN close -> rule 1
            _bar(1, 1.0, None, 0.5, 1.0),              # null high -> rule 1
            _bar(2, 1.0, 2.0, 0.0, 1.0),               # price 0 -> rule 2
            _bar(3, 1.0, 2.0, 0.01, 1.0),              # 0.01 is rejected -> rule 2
            _bar(4, 1.0, 2.0, -1.0, 1.0),              # -1 -> rule 2
            _bar(5, 1.0, 2.0, 0.5, 1.0, -1),           # volume -1 -> rule 3
            _bar(6, 1.0, 0.5, 0.9, 1.0),               # high < low -> rule 4
            _bar(7, 1.0, 2.0, 0.5, 1.0)]               # good
    c = V.classify(spark.createDataFrame(rows, schemas.BARS))
    got = {r["timestamp"]: r["rule"] for r in c.collect()}
    assert [got[T0 + dt.timedelta(minutes=10 * i)] for i in range(8)] == [1, 1, 2, 2, 2, 3, 4, None]
    ev = {(r["event_type"], r["bar_count"]) for r in V.events(c).collect()}
    assert ev == {("INVALID_PRICE", 2), ("INVALID_PRICE", 3), ("INVALID_VOLUME", 1), ("OHLC_INCONSISTENCY", 1)}


def test_spike_pair(spark):
    b = bars_df(spark, [100.0, 160.0, 100.0, 125.0, 126.0], ticker="S")
    clean, events = V.circuit_breaker(b)
    assert sorted(r["close"] for r in clean.collect()) == [100.0, 100.0, 125.0, 126.0]
    msgs = {r["event_type"]: r["message"] for r in events.collect()}
    assert msgs["EXTREME_SPIKE_REMOVED"] == "1 bars dropped: the close moved over 50% (at most 60.0%)"
    assert msgs["PRICE_SPIKE_FLAGGED"] == \
        "2 bars kept though the close moved 20% to 50%, the ticker's largest move being 60.0%"


def test_clean_plus_removed_is_input(spark, sf_dir):
    d = A.dirty_bars(spark, sf_dir)
    c = V.classify(d)
    removed = c.where(F.col("rule").isNotNull() & (F.col("rule") != V.RULE_SPIKE)).count()
    assert V.clean(c).count() + removed == d.count()


def test_null_open_window_and_empty_window(spark):
    from barwise.operators.resample import resample
    rows = [("R", T0, None, 2.0, 1.0, 1.5, 10), ("R", T0 + dt.timedelta(minutes=5), 1.7, 2.5, 1.2, 2.0, 5),
            ("R", T0 + dt.timedelta(minutes=20), 1.0, 1.0, 1.0, None, 1)]
    out = resample(spark.createDataFrame(rows, schemas.BARS), 10).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (1.7, 2.5, 1.0, 2.0, 15)


def test_gap_and_freshness(spark):
    b = bars_df(spark, [1.0, 1.0, 1.0], step_min=30)
    g = Q.intraday_gaps(b).collect()
    assert [r["gap_minutes"] for r in g] == [30, 30]
    asof = F.lit("2024-01-04 10:30:00").cast("timestamp_ntz")
    f = Q.freshness(b, asof).collect()
    assert f[0]["message"] == "newest bar is 48.0 hours old (2024-01-02 10:30:00)"
    assert Q.freshness(b, F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")).count() == 0


def test_event_log_ids_are_stable(spark, sf_dir):
    ev = V.events(V.classify(A.dirty_bars(spark, sf_dir)))
    a = Q.to_event_log(ev, A.as_of_lit()).select("event_id").collect()
    b = Q.to_event_log(ev, A.as_of_lit()).select("event_id").collect()
    assert sorted(a) == sorted(b) and len(set(a)) == len(a)


def test_spike_against_survivor_days_earlier(spark):
    # previous surviving bar is two days back (the day between has only a rejected bar)
    rows = [_bar(0, 100.0, 101.0, 99.0, 100.0, ticker="D")]
    mid = list(_bar(0, 1.0, 1.0, 1.0, None, ticker="D"))
    mid[1] = T0 + dt.timedelta(days=1)
    last = list(_bar(0, 130.0, 131.0, 129.0, 130.0, ticker="D"))
    last[1] = T0 + dt.timedelta(days=2)
    c = V.classify(spark.createDataFrame(rows + [tuple(mid), tuple(last)], schemas.BARS))
    got = {r["timestamp"].day - T0.day: (r["rule"], r["pct_change"]) for r in c.collect()}
    assert got[1][0] == V.RULE_NULL
    assert got[2][0] == V.RULE_SPIKE and abs(got[2][1] - 0.3) < 1e-12
    assert got[0] == (None, None)
