"""Column expressions for the technical indicators and signal scoring.

All are plain Catalyst expressions (no Python UDFs), so they stay inside whole-stage
codegen. ANSI mode is on in Spark 4, so every division is a ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Params


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def true_range(high: str, low: str, prev_close: str) -> Column:
    """max(h - l, |h - c'|, |l - c'|)."""
    h, l, pc = col(high), col(low), col(prev_close)
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def vm_plus(high: str, prev_low: str) -> Column:
    return F.abs(col(high) - col(prev_low))


def vm_minus(low: str, prev_high: str) -> Column:
    return F.abs(col(low) - col(prev_high))


def rsi_from_means(avg_gain: Column, avg_loss: Column) -> Column:
    """Simple-mean RSI: 100 when there is no loss, else 100 - 100 / (1 + g / l)."""
    return (F.when(avg_loss > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(avg_gain, avg_loss)))
            .otherwise(F.lit(100.0)))


def vortex_ratio(vm_sum: Column, tr_sum: Column) -> Column:
    """sum(VM) / sum(TR); null when the true-range sum is not positive."""
    return F.when(tr_sum > 0, F.try_divide(vm_sum, tr_sum))


def vote(conds: list[Column], k: int) -> Column:
    """True when at least ``k`` of ``conds`` hold (null conditions count as false)."""
    total = None
    for c in conds:
        term = F.coalesce(c, F.lit(False)).cast("int")
        total = term if total is None else total + term
    return total >= k


def trends(p: Params, up: bool) -> list[Column]:
    """The three readings of a bar in one direction: trend, momentum, range."""
    pairs = [("sma20", "sma50"), ("vortex_positive", "vortex_negative")]
    sides = [F.col(a) > F.col(b) if up else F.col(a) < F.col(b) for a, b in pairs]
    rsi = F.col("rsi") < p.rsi_overbought if up else F.col("rsi") > p.rsi_overbought
    return [*sides, rsi]


def buy_condition(p: Params = DEFAULT) -> Column:
    """All three readings point up; an unknown one counts as not."""
    return vote(trends(p, up=True), 3)


SIGNAL_INPUTS = ["sma20", "sma50", "rsi", "vortex_positive", "vortex_negative"]


def sell_condition(p: Params = DEFAULT) -> Column:
    """All inputs present and at least two of SMA20 < SMA50, RSI > overbought, VI+ < VI-."""
    present = None
    for c in SIGNAL_INPUTS:
        present = F.col(c).isNotNull() if present is None else present & F.col(c).isNotNull()
    return present & vote(trends(p, up=False), 2)


def signal_score(p: Params = DEFAULT, signal: str = "signal") -> Column:
    """Composite strength 0..100 (1 dp): the weighted sum of three shares, each cut to 0..1:
    the SMA spread in the label's direction, the RSI's distance from its threshold, and the
    Vortex spread. Any null input, or a label other than BUY / SELL, scores 0."""
    label = F.col(signal)
    side = F.when(label == "BUY", 1.0).when(label == "SELL", -1.0)
    spread = F.try_divide(side * (F.col("sma20") - F.col("sma50")), F.col("sma50")) * 100
    room = F.when(side > 0, F.lit(p.rsi_overbought) - F.col("rsi")).otherwise(F.col("rsi") - F.lit(p.rsi_oversold))
    vortex = side * (F.col("vortex_positive") - F.col("vortex_negative"))

    def share(x: Column, full: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / full)) * 100

    score = F.round(p.w_sma * share(spread, p.score_sma_cap_pct) + p.w_rsi * share(room, p.score_rsi_span)
                    + p.w_vortex * share(vortex, p.score_vortex_cap), 1)
    # greatest / least skip nulls, so a missing input must be caught before the cuts
    known = spread.isNotNull() & room.isNotNull() & vortex.isNotNull()
    return F.when(known, score).otherwise(F.lit(0.0))


def level_factors(p: Params = DEFAULT) -> dict[str, float]:
    """Multipliers of the close for stop-loss and take-profit levels."""
    return {
        "buy_stop": 1 - p.stop_loss_pct, "buy_take": 1 + p.take_profit_pct,
        "sell_stop": 1 + p.stop_loss_pct, "sell_take": 1 - p.take_profit_pct,
    }


def stop_loss(p: Params = DEFAULT) -> Column:
    f = level_factors(p)
    return (F.when(F.col("signal") == "BUY", F.round(F.col("close") * f["buy_stop"], 4))
            .otherwise(F.round(F.col("close") * f["sell_stop"], 4)))


def take_profit(p: Params = DEFAULT) -> Column:
    f = level_factors(p)
    return (F.when(F.col("signal") == "BUY", F.round(F.col("close") * f["buy_take"], 4))
            .otherwise(F.round(F.col("close") * f["sell_take"], 4)))


def rsi_zone(p: Params = DEFAULT) -> Column:
    r = F.col("rsi")
    return (F.when(r > p.rsi_overbought, "overbought")
            .when(r < p.rsi_oversold, "oversold")
            .when(r.isNotNull(), "neutral"))
