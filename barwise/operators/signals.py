"""SIG-1..7: BUY / SELL rules, score, stop / take levels, cooldown, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Params
from ..functions import indicators as X
from ..functions.numeric import round_half_up

SIGNAL_COLS = [f.name for f in schemas.SIGNALS.fields]
GEN1_COLS = [f.name for f in schemas.SIGNALS_GEN1.fields]


def buy_candidates(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return ind.where(X.buy_condition(p)).withColumn("signal", F.lit("BUY"))


def sell_candidates(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return ind.where(X.sell_condition(p)).withColumn("signal", F.lit("SELL"))


def label_signals(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One pass over the indicators: label each row BUY, SELL or nothing.

    The two rules are exclusive (BUY needs SMA20 > SMA50 and VI+ > VI-, SELL needs two
    of the opposite), so a single CASE replaces a union of two scans.
    """
    label = F.when(X.buy_condition(p), "BUY").when(X.sell_condition(p), "SELL")
    return ind.withColumn("signal", label).where(F.col("signal").isNotNull())


def score_and_levels(cands: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return cands.select(
        *[F.col(c) for c in cands.columns],
        X.signal_score(p).alias("signal_score"),
        X.stop_loss(p).alias("stop_loss"),
        X.take_profit(p).alias("take_profit"))


def signals(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Scored BUY and SELL rows in the 12-column signal layout."""
    return score_and_levels(label_signals(ind, p), p).select(*SIGNAL_COLS)


def signals_gen1(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Generation 1: BUY rows only, nine columns."""
    return buy_candidates(ind, p).select(*GEN1_COLS)


def last_signal_times(history: DataFrame) -> DataFrame:
    """AGG-5: latest stored signal time per (ticker, signal)."""
    return history.groupBy("ticker", "signal").agg(F.max("timestamp").alias("last_signal_time"))


def apply_cooldown(cands: DataFrame, history: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """SIG-5: keep a candidate if no signal of the same (ticker, label) is stored, or the
    latest stored one is more than ``cooldown_seconds`` older (whole seconds). Candidates
    in one batch do not suppress each other; older candidates are dropped.

    The per-key maxima are one row per (ticker, label): bounded by the key count, they
    are broadcast only when the planner's size estimate says they are small.
    """
    last = last_signal_times(history)
    j = cands.join(last, ["ticker", "signal"], "left")
    dist = F.unix_timestamp("timestamp") - F.unix_timestamp("last_signal_time")
    keep = F.col("last_signal_time").isNull() | (dist > p.cooldown_seconds)
    return j.where(keep).drop("last_signal_time")


def split_buy_sell(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-7: the BUY rows and the SELL rows of one frame."""
    return sig.where(F.col("signal") == "BUY"), sig.where(F.col("signal") == "SELL")


def annotation(p: Params = DEFAULT) -> Column:
    """SIG-7: marker text, e.g. ``BUY @ $12.34<br>Score: 57/100<br>SL: $11.97<br>TP: $13.08``."""
    r2 = lambda c: round_half_up(F.col(c), 2)
    head = F.format_string("%s @ $%.2f", F.col("signal"), r2("close"))
    score = F.when(F.col("signal_score").isNotNull() & ~F.isnan("signal_score"),
                   F.format_string("Score: %.0f/100", round_half_up(F.col("signal_score"), 0)))
    sl = F.when(F.col("stop_loss").isNotNull(), F.format_string("SL: $%.2f", r2("stop_loss")))
    tp = F.when(F.col("take_profit").isNotNull(), F.format_string("TP: $%.2f", r2("take_profit")))
    return F.concat_ws("<br>", head, score, sl, tp)
