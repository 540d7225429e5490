"""VAL-1..7: circuit breaker over OHLCV bars.

Each bar is classified once with the first rule it breaks, in the reference order:
null/NaN price, price at or below the floor, negative (or missing) volume, high < low.
The spike test then runs over the survivors only: the bar-to-bar change is measured
against the previous *surviving* bar, once, before any spike is removed, so the bar
after a removed spike is judged against the spike. Changes above 50 % are removed,
changes in (20 %, 50 %] are flagged and kept.

Outputs are one classified relation, from which ``clean`` and ``events`` are plain
filters and one aggregate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params

# fixed values: event types
INVALID_PRICE = "INVALID_PRICE"
INVALID_VOLUME = "INVALID_VOLUME"
OHLC_INCONSISTENCY = "OHLC_INCONSISTENCY"
EXTREME_SPIKE_REMOVED = "EXTREME_SPIKE_REMOVED"
PRICE_SPIKE_FLAGGED = "PRICE_SPIKE_FLAGGED"

RULE_NULL, RULE_FLOOR, RULE_VOLUME, RULE_OHLC, RULE_EXTREME, RULE_SPIKE = 1, 2, 3, 4, 5, 6
RULE_EVENT = {RULE_NULL: INVALID_PRICE, RULE_FLOOR: INVALID_PRICE, RULE_VOLUME: INVALID_VOLUME,
              RULE_OHLC: OHLC_INCONSISTENCY, RULE_EXTREME: EXTREME_SPIKE_REMOVED,
              RULE_SPIKE: PRICE_SPIKE_FLAGGED}

PRICES = ["open", "high", "low", "close"]
BAR_COLS = ["ticker", "timestamp", "open", "high", "low", "close", "volume"]


def _bad_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def _pct_text(x: Column) -> Column:
    """``x`` as a percentage with one decimal, e.g. 0.6 -> '60.0%'. Rounded as
    round(x * 1000) / 10 first so every engine prints the same digit."""
    return F.format_string("%.1f%%", F.round(x * 1000) / 10)


def classify(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Bars plus ``rule`` (null = passes) and ``pct_change`` (survivors of rules 1-4)."""
    any_bad = None
    for c in PRICES:
        any_bad = _bad_number(c) if any_bad is None else any_bad | _bad_number(c)
    rule = (F.when(any_bad, RULE_NULL)
            .when(F.least(*[F.col(c) for c in PRICES]) <= p.min_valid_price, RULE_FLOOR)
            .when(F.col("volume").isNull() | (F.col("volume") < 0), RULE_VOLUME)
            .when(F.col("high") < F.col("low"), RULE_OHLC))
    ruled = bars.select(*BAR_COLS, rule.alias("rule"))
    prev = previous_close(ruled, p.order_bucket, valid=F.col("rule").isNull())
    passed = F.col("rule").isNull()
    pct = F.when(passed, F.abs(F.try_divide(F.col("close"), F.col("_prev_close")) - 1))
    return (prev.withColumn("pct_change", pct).drop("_prev_close")
            .withColumn("rule", F.when(~passed, F.col("rule"))
                        .when(F.col("pct_change") > p.extreme_bar_pct_change, RULE_EXTREME)
                        .when(F.col("pct_change") > p.max_bar_pct_change, RULE_SPIKE)))


def previous_close(rows: DataFrame, bucket: str = "day", valid: Column | None = None) -> DataFrame:
    """``_prev_close``: close of the previous *valid* row of the same ticker in time order
    (all rows are valid when ``valid`` is None).

    Skew-safe form of a lag over the whole ticker: within (ticker, time bucket) it is the
    last valid close before the row (``last`` ignoring nulls over a growing frame); the
    first rows of a bucket take the last valid close of the nearest earlier bucket that
    has one, found over one row per (ticker, bucket). Exact, one pass over the rows (no
    union of valid and invalid rows), and a ticker's rows are spread over its buckets."""
    ok = F.lit(True) if valid is None else valid
    b = rows.withColumn("_bk", F.date_trunc(bucket, "timestamp")).withColumn("_ok", ok)
    good_close = F.when(F.col("_ok"), F.col("close"))
    before = Window.partitionBy("ticker", "_bk").orderBy("timestamp").rowsBetween(
        Window.unboundedPreceding, -1)
    in_bucket = F.last(good_close, ignorenulls=True).over(before)
    last = b.groupBy("ticker", "_bk").agg(
        F.max_by("close", F.when(F.col("_ok"), F.col("timestamp"))).alias("_last"))
    earlier = Window.partitionBy("ticker").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("ticker", "_bk", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    c = carry.select(F.col("ticker").alias("_t"), F.col("_bk").alias("_b"), "_carry")
    staged = b.withColumn("_in", in_bucket)
    # null tickers and times are groups like any other
    return (staged.join(c, staged["ticker"].eqNullSafe(c["_t"]) & staged["_bk"].eqNullSafe(c["_b"]))
            .withColumn("_prev_close", F.coalesce(F.col("_in"), F.col("_carry")))
            .drop("_bk", "_ok", "_in", "_carry", "_t", "_b"))


def clean(classified: DataFrame) -> DataFrame:
    """Bars that pass (flagged spikes are kept)."""
    keep = F.col("rule").isNull() | (F.col("rule") == RULE_SPIKE)
    return classified.where(keep).select(*BAR_COLS)


def events(classified: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One event per (ticker, rule) with the count and message; spike messages carry the
    worst change of the ticker over both spike classes."""
    per_rule = (classified.where(F.col("rule").isNotNull())
                .groupBy("ticker", "rule")
                .agg(F.count(F.lit(1)).alias("n"), F.max("pct_change").alias("rule_max")))
    worst = F.max("rule_max").over(Window.partitionBy("ticker"))
    per_rule = per_rule.withColumn("worst", worst)
    n = F.col("n")
    lo_pct = int(round(p.max_bar_pct_change * 100))
    hi_pct = int(round(p.extreme_bar_pct_change * 100))
    msg = (F.when(F.col("rule") == RULE_NULL, F.format_string("%d bars dropped: a price is missing", n))
           .when(F.col("rule") == RULE_FLOOR,
                 F.format_string(f"%d bars dropped: a price is not above {p.min_valid_price}", n))
           .when(F.col("rule") == RULE_VOLUME, F.format_string("%d bars dropped: the volume is below zero", n))
           .when(F.col("rule") == RULE_OHLC, F.format_string("%d bars dropped: the high lies under the low", n))
           .when(F.col("rule") == RULE_EXTREME,
                 F.concat(F.format_string(f"%d bars dropped: the close moved over {hi_pct}%% (at most ", n),
                          _pct_text(F.col("worst")), F.lit(")")))
           .otherwise(F.concat(
               F.format_string(f"%d bars kept though the close moved {lo_pct}%% to {hi_pct}%%, the ticker's largest move being ", n),
               _pct_text(F.col("worst")))))
    etype = F.element_at(F.create_map(*[x for k, v in RULE_EVENT.items() for x in (F.lit(k), F.lit(v))]),
                         F.col("rule"))
    return per_rule.select(etype.alias("event_type"), "ticker", msg.alias("message"),
                           n.cast("int").alias("bar_count"))


def circuit_breaker(bars: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(clean bars, DQ events). A symbol whose bars are all rejected simply has no clean
    rows; its events are still returned."""
    c = classify(bars, p)
    return clean(c), events(c, p)
