"""Golden micro-fixtures for the indicator formulas and warm-up gates."""

import math

import pytest
from pyspark.sql import functions as F

from barwise.config import DEFAULT, GEN1
from barwise.operators import indicators as IND
from barwise.operators import signals as SIG

from helpers import bars_df, by_ts


def test_ramp60_edges(spark):
    rows = by_ts(IND.indicators(bars_df(spark, [float(i) for i in range(1, 61)])))
    n = {i + 1: r for i, r in enumerate(rows)}
    assert n[19]["sma20"] is None and n[20]["sma20"] == pytest.approx(10.5)
    assert n[49]["sma50"] is None and n[50]["sma50"] == pytest.approx(25.5)
    assert n[50]["sma20"] == pytest.approx(40.5)
    assert n[14]["rsi"] is None and n[15]["rsi"] == 100.0
    assert n[15]["vortex_positive"] is None and n[16]["vortex_positive"] is not None
    # high = c + 1, low = c - 1: TR = 2, VM+ = |h - l'| = 3, VM- = |l - h'| = 1
    assert n[16]["vortex_positive"] == pytest.approx(1.5)
    assert n[16]["vortex_negative"] == pytest.approx(0.5)


def test_gen1_partial_warmup(spark):
    rows = by_ts(IND.indicators(bars_df(spark, [float(i) for i in range(1, 61)]), GEN1))
    assert rows[0]["sma20"] == pytest.approx(1.0)
    assert rows[4]["sma50"] == pytest.approx(3.0)
    assert rows[13]["rsi"] is None and rows[14]["rsi"] == 100.0
    assert rows[14]["vortex_positive"] is not None


def test_flat60_no_vortex_no_signals(spark):
    b = bars_df(spark, [5.0] * 60, highs=[5.0] * 60, lows=[5.0] * 60)
    ind = IND.indicators(b)
    rows = by_ts(ind)
    assert all(r["vortex_positive"] is None for r in rows)
    assert rows[59]["rsi"] == 100.0
    assert SIG.signals(ind).count() == 0


def test_zigzag_rsi_50(spark):
    rows = by_ts(IND.indicators(bars_df(spark, [10.0 if i % 2 == 0 else 11.0 for i in range(40)])))
    assert all(r["rsi"] == pytest.approx(50.0) for r in rows[14:])


def test_chunked_equals_plain(spark):
    closes = [100 + ((i * 37) % 23) - ((i * 11) % 7) * 0.5 for i in range(700)]
    b = bars_df(spark, closes, step_min=60).unionByName(bars_df(spark, closes[::-1], ticker="U", step_min=60))
    for p in (DEFAULT, GEN1, DEFAULT.with_(order_bucket="hour")):
        plain = IND.indicators(b, p)
        chunked = IND.indicators_chunked(b, p, chunk_rows=60)
        assert plain.count() == chunked.count() == 1400
        assert plain.exceptAll(chunked).count() == 0


def test_chunk_size_must_cover_history(spark):
    with pytest.raises(ValueError):
        IND.indicators_chunked(bars_df(spark, [1.0, 2.0]), DEFAULT, chunk_rows=10)


def replayed_tail(closes, highs, lows):
    """Generation 1, bar by bar: a state of the last 50 bars, and the newest bar's values over it."""
    state, out = [], []
    for bar in zip(closes, highs, lows):
        state = [*state, bar][-50:]
        c, h, lo = zip(*state)
        n = len(state)
        row = {"sma20": sum(c[-20:]) / len(c[-20:]), "sma50": sum(c) / n, "rsi": None, "vp": None, "vn": None}
        if n >= 15:
            steps = [b - a for a, b in zip(c[-15:], c[-14:])]
            gain, loss = (sum(max(s * x, 0) for x in steps) / 14 for s in (1, -1))
            row["rsi"] = 100 - 100 / (1 + gain / loss) if loss > 0 else 100.0
            true = sum(max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(-14, 0))
            row["vp"] = sum(abs(h[i] - lo[i - 1]) for i in range(-14, 0)) / true
            row["vn"] = sum(abs(lo[i] - h[i - 1]) for i in range(-14, 0)) / true
        out.append(row)
    return out


def test_gen1_tail_equals_a_bar_by_bar_replay(spark):
    closes = [100 + 9 * math.sin(i / 5) + (i * 37 % 11) / 3 for i in range(130)]
    highs = [c + 1 + i % 3 for i, c in enumerate(closes)]
    lows = [c - 1 - i % 4 for i, c in enumerate(closes)]
    rows = by_ts(IND.indicators_tail(bars_df(spark, closes, highs=highs, lows=lows)))
    want = replayed_tail(closes, highs, lows)
    assert len(rows) == 130
    for got, w in zip(rows, want):
        for c, x in (("sma20", "sma20"), ("sma50", "sma50"), ("rsi", "rsi"), ("vortex_positive", "vp"), ("vortex_negative", "vn")):
            assert got[c] == (None if w[x] is None else pytest.approx(w[x], abs=1e-9)), (got, w)


def test_plain_plan_has_one_exchange(spark):
    from barwise.sources import adapters as A
    ind = IND.indicators(A.bars_1h(spark, "/root/testdata/sf0.001"))
    plan = ind._jdf.queryExecution().executedPlan().toString()
    # aggregate of events -> bars, then the indicator window reuses that partitioning
    assert plan.count("Exchange hashpartitioning") <= 2
