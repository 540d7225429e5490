"""Signal rules, score clamps and the cooldown distance test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwise import schemas
from barwise.config import DEFAULT
from barwise.functions import indicators as X
from barwise.operators import indicators as IND
from barwise.operators import signals as SIG
from barwise.sources import adapters as A

T = dt.datetime(2024, 1, 5, 12, 0)


def _ind(spark, rows):
    return spark.createDataFrame(rows, schemas.INDICATORS)


def _score(spark, label, s20, s50, rsi, vp, vn):
    df = _ind(spark, [("X", T, 10.0, s20, s50, rsi, vp, vn)]).withColumn("signal", F.lit(label))
    return df.select(X.signal_score(DEFAULT).alias("s")).first()["s"]


def test_score_edges(spark):
    assert _score(spark, "BUY", 105.0, 100.0, 30.0, 0.9, 0.6) == pytest.approx(100.0)
    assert _score(spark, "BUY", 110.0, 100.0, 10.0, 1.9, 0.6) == pytest.approx(100.0)   # clamps
    assert _score(spark, "BUY", 100.0, 100.0, 70.0, 0.6, 0.6) == 0.0
    assert _score(spark, "BUY", None, 100.0, 30.0, 0.9, 0.6) == 0.0                   # null input
    assert _score(spark, "HOLD", 105.0, 100.0, 30.0, 0.9, 0.6) == 0.0                 # unknown label
    assert _score(spark, "SELL", 95.0, 100.0, 90.0, 0.6, 0.9) == pytest.approx(100.0)


def test_buy_sell_disjoint_and_scored(spark, sf_dir):
    sig = SIG.signals(IND.indicators(A.bars_1h(spark, sf_dir)))
    ind = IND.indicators(A.bars_1h(spark, sf_dir))
    both = ind.where(X.buy_condition() & X.sell_condition()).count()
    assert both == 0
    r = sig.agg(F.min("signal_score").alias("lo"), F.max("signal_score").alias("hi")).first()
    assert 0.0 <= r["lo"] and r["hi"] <= 100.0


def test_levels(spark):
    df = _ind(spark, [("X", T, 100.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    out = df.withColumn("signal", F.lit("BUY")).select(SIG.X.stop_loss().alias("sl"),
                                                       SIG.X.take_profit().alias("tp")).first()
    assert (out["sl"], out["tp"]) == (97.0, 106.0)


@pytest.mark.parametrize("gap,kept", [(1800, False), (1801, True), (-60, False), (None, True)])
def test_cooldown_edges(spark, gap, kept):
    cand = _ind(spark, [("X", T, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]).withColumn("signal", F.lit("BUY"))
    hist_rows = [] if gap is None else [("X", T - dt.timedelta(seconds=gap), "BUY")]
    hist = spark.createDataFrame(hist_rows, "ticker string, timestamp timestamp_ntz, signal string")
    assert (SIG.apply_cooldown(cand, hist).count() == 1) is kept


def test_annotation(spark):
    df = spark.createDataFrame([("BUY", 12.5, 57.5, 12.125, None)],
                               "signal string, close double, signal_score double, stop_loss double, take_profit double")
    assert df.select(SIG.annotation().alias("t")).first()["t"] == "BUY @ $12.50<br>Score: 58/100<br>SL: $12.13"
