"""IND-1..9: rolling indicators per ticker as window expressions.

The relation is one window specification (partition by ticker, order by time), so the
physical plan has one Exchange on ``ticker`` and one Sort; the lags and the row number
are computed first, the rolling frames over the lag-derived columns in a second Window
node on the same sorted data.

For inputs with few tickers and long histories ``indicators_chunked`` splits each
ticker into fixed-size chunks with a halo of the previous rows, so the work spreads
over many tasks while giving the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Params
from ..functions import indicators as X

OUT_COLS = [f.name for f in schemas.INDICATORS.fields]


def _with_inputs(bars: DataFrame, part: list[str], order: str) -> DataFrame:
    """Row number and previous-bar values within each partition."""
    w = Window.partitionBy(*part).orderBy(order)
    return bars.select(
        *[F.col(c) for c in bars.columns],
        F.row_number().over(w).alias("_rn"),
        F.lag("close").over(w).alias("_pc"),
        F.lag("high").over(w).alias("_ph"),
        F.lag("low").over(w).alias("_pl"))


def _rolling(df: DataFrame, part: list[str], order: str, n: Column, p: Params) -> DataFrame:
    """Rolling SMA / RSI / Vortex over rows ordered by ``order``; warm-up gated on ``n``."""
    w = Window.partitionBy(*part).orderBy(order)

    def frame(rows: int):
        return w.rowsBetween(-(rows - 1), Window.currentRow)

    delta = F.col("close") - F.col("_pc")
    gain = F.greatest(delta, F.lit(0.0))
    loss = F.greatest(-delta, F.lit(0.0))
    tr = X.true_range("high", "low", "_pc")
    vmp = X.vm_plus("high", "_pl")
    vmn = X.vm_minus("low", "_ph")

    sma_s = F.avg("close").over(frame(p.sma_short))
    sma_l = F.avg("close").over(frame(p.sma_long))
    if p.warmup == "gated":
        sma_s = F.when(n >= p.sma_short, sma_s)
        sma_l = F.when(n >= p.sma_long, sma_l)
    g = F.avg(gain).over(frame(p.rsi_period))
    lo = F.avg(loss).over(frame(p.rsi_period))
    rsi = F.when(n >= p.rsi_min_rows, X.rsi_from_means(g, lo))
    trs = F.sum(tr).over(frame(p.vortex_period))
    vp = F.sum(vmp).over(frame(p.vortex_period))
    vn = F.sum(vmn).over(frame(p.vortex_period))
    ready = n >= p.vortex_min_rows
    return df.select(
        *[F.col(c) for c in df.columns],
        sma_s.alias("sma20"), sma_l.alias("sma50"), rsi.alias("rsi"),
        F.when(ready, X.vortex_ratio(vp, trs)).alias("vortex_positive"),
        F.when(ready, X.vortex_ratio(vn, trs)).alias("vortex_negative"))


def indicators(bars: DataFrame, p: Params = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One indicator row per bar: close, SMA20/50, RSI(14), VI+/VI-(14); ``keep`` names
    further bar columns to carry through (e.g. open and volume for a chart)."""
    base = ["ticker", "timestamp", "high", "low", "close"]
    b = bars.select(*base, *[c for c in keep if c not in base])
    staged = _with_inputs(b, ["ticker"], "timestamp")
    out = _rolling(staged, ["ticker"], "timestamp", F.col("_rn"), p)
    return out.select(*OUT_COLS, *[c for c in keep if c not in OUT_COLS])


def last_rows(df: DataFrame, n: int, key: str = "ticker", order: str = "timestamp") -> DataFrame:
    """WIN-7: the last ``n`` rows per key (Catalyst plans a WindowGroupLimit first)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_tail_rank", F.row_number().over(w)).where(
        F.col("_tail_rank") <= n).drop("_tail_rank")


def indicators_tail(bars: DataFrame, p: Params | None = None) -> DataFrame:
    """IND-8, generation 1: each bar's indicators over the ``history_rows`` bars up to it,
    with partial SMA warm-up. That generation keeps this many bars between batches and
    counts rows inside them; no frame is longer and no gate asks for more rows, so the
    values are those of frames over the whole ticker, for every bar."""
    from ..config import GEN1
    p = p or GEN1
    return indicators_chunked(bars, p, p.chunk_rows)


def with_rsi_zone(ind: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """IND-9: overbought / oversold / neutral label next to each RSI value."""
    return ind.withColumn("rsi_zone", X.rsi_zone(p))


# ---------------------------------------------------------------------------------
# Chunked form for few, long tickers (§4.3-1 of the survey).
# ---------------------------------------------------------------------------------

def global_row_number(bars: DataFrame, day_col: str = "_day", bucket: str = "day") -> DataFrame:
    """1-based row number per ticker in time order without a per-ticker sort of all rows.

    Rows are counted per (ticker, time bucket); a running sum over that small table gives
    each bucket's offset; the in-bucket rank is a window partitioned by (ticker, bucket).
    """
    d = bars.withColumn(day_col, F.date_trunc(bucket, "timestamp"))
    per_day = d.groupBy("ticker", day_col).agg(F.count(F.lit(1)).alias("_cnt"))
    wd = Window.partitionBy("ticker").orderBy(day_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("ticker", day_col,
                             F.coalesce(F.sum("_cnt").over(wd), F.lit(0)).alias("_off"))
    win_day = Window.partitionBy("ticker", day_col).orderBy("timestamp")
    ranked = d.withColumn("_inday", F.row_number().over(win_day))
    # null tickers and times are groups like any other (their rows are ranked first)
    o = offsets.select(F.col("ticker").alias("_t"), F.col(day_col).alias("_d"), "_off")
    return (ranked.join(o, ranked["ticker"].eqNullSafe(o["_t"]) & ranked[day_col].eqNullSafe(o["_d"]))
            .withColumn("_gn", F.col("_off") + F.col("_inday"))
            .drop("_off", "_inday", day_col, "_t", "_d"))


def indicators_chunked(bars: DataFrame, p: Params = DEFAULT, chunk_rows: int = 5000,
                       keep: tuple[str, ...] = (), before: DataFrame | None = None) -> DataFrame:
    """Same values as ``indicators`` with each ticker split into chunks of
    ``chunk_rows`` rows. Each chunk also receives the last ``history_rows + 5`` rows of
    the previous chunk as a halo, so every rolling frame and lag is complete; warm-up
    gates use the global row number, never the in-chunk one. ``before`` (ticker, _before)
    gives the number of older bars of a ticker that ``bars`` leaves out."""
    halo = p.history_rows + 5
    if chunk_rows < halo:
        raise ValueError(f"chunk_rows must be >= {halo}")
    base = ["ticker", "timestamp", "high", "low", "close"]
    b = global_row_number(bars.select(*base, *[c for c in keep if c not in base]),
                          bucket=p.order_bucket)
    seen = F.col("_gn")
    if before is not None:
        b = b.join(before, "ticker", "left")
        seen = seen + F.coalesce("_before", F.lit(0))
    chunk = F.floor((F.col("_gn") - 1) / chunk_rows).cast("long")
    pos = (F.col("_gn") - 1) % chunk_rows
    # each row goes to its own chunk, and the last ``halo`` rows of a chunk also to the
    # next one (as halo): one pass with inline, not a union that re-reads the input
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))
    carried = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))
    copies = F.when(pos >= chunk_rows - halo, F.array(own, carried)).otherwise(F.array(own))
    cols = [c for c in b.columns]
    both = b.select(*cols, F.inline(copies))
    part = ["ticker", "_chunk"]
    staged = _with_inputs(both, part, "_gn")
    out = _rolling(staged, part, "_gn", seen, p)
    return out.where(~F.col("_halo")).select(*OUT_COLS, *[c for c in keep if c not in OUT_COLS])


def indicators_from(bars: DataFrame, touched: DataFrame, p: Params = DEFAULT,
                    chunk_rows: int = 5000) -> DataFrame:
    """The rows of ``indicators`` from each touched ticker's ``first_new`` time on.

    Of older bars only the last ``history_rows`` of a ticker are read into the windows (a
    ranked prefix, so Catalyst limits each group first); the warm-up gates add the number
    of bars before them. ``touched``: (ticker, first_new), one row for each ticker."""
    base = ["ticker", "timestamp", "high", "low", "close"]
    t = bars.select(*base).join(touched.select("ticker", "first_new"), "ticker")
    older = t.where(F.col("timestamp") < F.col("first_new"))
    near = last_rows(older.select("ticker", "timestamp"), p.history_rows)
    edge = near.groupBy("ticker").agg(F.min("timestamp").alias("_edge"), F.count(F.lit(1)).alias("_taken"))
    counts = older.groupBy("ticker").agg(F.count(F.lit(1)).alias("_older"))
    before = counts.join(edge, "ticker").select("ticker", "_edge", (F.col("_older") - F.col("_taken")).alias("_before"))
    rows = t.join(before.select("ticker", "_edge"), "ticker", "left") \
        .where(F.col("timestamp") >= F.coalesce("_edge", "first_new"))
    out = indicators_chunked(rows.select(*base), p, chunk_rows, before=before.select("ticker", "_before"))
    return out.join(touched.select("ticker", "first_new"), "ticker") \
        .where(F.col("timestamp") >= F.col("first_new")).select(*OUT_COLS)
