"""POR-1..11: positions, stop / take exits, trade log entries and the portfolio fold.

Everything is a join or an aggregate keyed by ticker. Latest-row-per-ticker uses
``max_by`` over a struct (an aggregate with map-side partial aggregation, so a ticker
holding a third of all rows costs one row per input partition before the shuffle)
instead of sorting every row of a ticker in a window.

``merge_portfolio`` is MERGE with ordered clauses as a full outer join: the matching
clause number is computed once per row, then one CASE per column; right-hand sides
read the old target values because every input is a column of the joined row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Params

STOP_LOSS = "STOP_LOSS"
TAKE_PROFIT = "TAKE_PROFIT"

TRADE_COLS = ["ticker", "signal", "signal_score", "price", "quantity", "pnl_realized",
              "stop_loss", "take_profit", "timestamp"]
PORT_COLS = [f.name for f in schemas.PORTFOLIO.fields]


def latest_by_key(df: DataFrame, cols: list[str], key: str = "ticker",
                  order: list[str] | None = None) -> DataFrame:
    """WIN-1: the newest row per key (ties broken by the remaining ``order`` columns)."""
    order = order or ["timestamp"]
    ordering = F.struct(*[F.col(c) for c in order])
    row = F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_r")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def current_prices(bars: DataFrame) -> DataFrame:
    """POR-1: last close per ticker with its bar time."""
    return latest_by_key(bars, ["close", "timestamp"]).select(
        "ticker", F.col("close").alias("current_price"), "timestamp")


def latest_buy_levels(signals: DataFrame) -> DataFrame:
    """POR-2: stop and take levels of the newest BUY that has a stop level."""
    buys = signals.where((F.col("signal") == "BUY") & F.col("stop_loss").isNotNull())
    return latest_by_key(buys, ["stop_loss", "take_profit"])


def exit_triggers(portfolio: DataFrame, bars: DataFrame, signals: DataFrame,
                  p: Params = DEFAULT) -> DataFrame:
    """POR-3: open positions whose current price is at or through the stop (else the
    take level) of the newest BUY; no stored level means the test cannot fire."""
    open_pos = (portfolio.where(F.col("holdings") > 0)
                .select("ticker", "holdings", "avg_entry_price", "realized_pnl", "total_trades")
                .join(current_prices(bars).drop("timestamp"), "ticker"))
    j = open_pos.join(latest_buy_levels(signals), "ticker", "left")
    price = F.col("current_price")
    hit_stop = price <= F.coalesce(F.col("stop_loss"), F.lit(p.no_stop_level))
    hit_take = price >= F.coalesce(F.col("take_profit"), F.lit(p.no_take_level))
    return (j.where(hit_stop | hit_take)
            .select("ticker", "holdings", "avg_entry_price", "realized_pnl", "total_trades",
                    "current_price",
                    F.when(hit_stop, STOP_LOSS).when(hit_take, TAKE_PROFIT).alias("exit_reason"),
                    ((price - F.col("avg_entry_price")) * F.col("holdings")).alias("exit_pnl")))


def exit_trades(triggers: DataFrame, as_of: Column) -> DataFrame:
    """POR-4 (log side): one trade row per triggered exit."""
    return triggers.select(
        "ticker", F.col("exit_reason").alias("signal"),
        F.lit(None).cast("double").alias("signal_score"),
        F.col("current_price").alias("price"),
        F.col("holdings").cast("long").alias("quantity"),
        F.col("exit_pnl").alias("pnl_realized"),
        F.lit(None).cast("double").alias("stop_loss"),
        F.lit(None).cast("double").alias("take_profit"),
        as_of.alias("timestamp"))


def close_positions(portfolio: DataFrame, triggers: DataFrame, as_of: Column) -> DataFrame:
    """POR-4 (portfolio side): exited tickers go flat, realized PnL and trade count grow."""
    t = triggers.select("ticker", F.col("current_price").alias("_x_price"),
                        F.col("exit_reason").alias("_x_reason"), F.col("exit_pnl").alias("_x_pnl"))
    j = portfolio.join(t, "ticker", "left")
    hit = F.col("_x_reason").isNotNull()

    def pick(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old)).alias(old)

    return schemas.conform(j.select(
        "ticker",
        pick(F.lit(0).cast("long"), "holdings"),
        "avg_entry_price",
        pick(F.col("_x_price"), "current_price"),
        pick(F.lit(0.0), "unrealized_pnl"),
        pick(F.coalesce(F.col("realized_pnl"), F.lit(0.0)) + F.col("_x_pnl"), "realized_pnl"),
        pick(F.coalesce(F.col("total_trades"), F.lit(0)) + 1, "total_trades"),
        pick(F.col("_x_reason"), "last_signal"),
        pick(as_of, "last_signal_time")), schemas.PORTFOLIO)


def portfolio_updates(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """POR-5: newest price per ticker, left join its newest signal."""
    price = current_prices(bars).drop("timestamp")
    sig = latest_by_key(signals, ["signal", "signal_score", "close", "stop_loss", "take_profit",
                                  "timestamp"], order=["timestamp", "signal"])
    sig = sig.select("ticker", F.col("signal").alias("last_signal"), "signal_score",
                     F.col("close").alias("signal_price"), "stop_loss", "take_profit",
                     F.col("timestamp").alias("last_signal_time"))
    return price.join(sig, "ticker", "left")


def new_trades(updates: DataFrame, log: DataFrame) -> DataFrame:
    """POR-8: updates whose signal is not in the log yet (NOT EXISTS as an anti join)."""
    keys = log.select("ticker", F.col("signal").alias("last_signal"),
                      F.col("timestamp").alias("last_signal_time"))
    return (updates.where(F.col("last_signal").isNotNull())
            .join(keys, ["ticker", "last_signal", "last_signal_time"], "left_anti"))


def trade_entries(trades: DataFrame, portfolio: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """POR-9: log rows for new signals. BUY logs the lot; a SELL logs the held quantity
    and realizes (signal price - entry) x holdings."""
    port = portfolio.select("ticker", F.col("avg_entry_price").alias("_p_avg"),
                            F.col("holdings").alias("_p_h"))
    j = trades.join(port, "ticker", "left")
    held = F.coalesce(F.col("_p_h"), F.lit(0))
    sig = F.col("last_signal")
    qty = F.when(sig == "BUY", F.lit(p.buy_shares)).otherwise(held).cast("long")
    pnl = (F.when((sig == "SELL") & (held > 0),
                  (F.col("signal_price") - F.coalesce(F.col("_p_avg"), F.lit(0.0))) * F.col("_p_h"))
           .otherwise(F.lit(0.0)))
    return j.select("ticker", sig.alias("signal"), "signal_score",
                    F.col("signal_price").alias("price"), qty.alias("quantity"),
                    pnl.alias("pnl_realized"), "stop_loss", "take_profit",
                    F.col("last_signal_time").alias("timestamp"))


def to_trade_log(rows: DataFrame, as_of: Column) -> DataFrame:
    """SNK-9: trade_id = xxhash64 of the natural key (deterministic, retry-safe)."""
    out = rows.withColumn("trade_id", F.xxhash64("ticker", "signal", "timestamp")) \
              .withColumn("created_at", as_of)
    return schemas.conform(out, schemas.TRADE_LOG)


def merge_clause(gen: str = "gen2") -> Column:
    """Number of the first matching MERGE clause (0 = target row left unchanged,
    null = source row ignored)."""
    t_in, s_in = F.col("_in_t").isNotNull(), F.col("_in_s").isNotNull()
    sig, h = F.col("_s_sig"), F.col("t_holdings")
    if gen == "gen1":
        return (F.when(t_in & s_in, 4).when(s_in & (sig == "BUY"), 5).when(t_in, 0))
    return (F.when(t_in & s_in & (sig == "SELL") & (h > 0), 1)
            .when(t_in & s_in & (sig == "BUY") & (h == 0), 2)
            .when(t_in & s_in & (sig == "BUY") & (h > 0), 3)
            .when(t_in & s_in, 4)
            .when(s_in & (sig == "BUY"), 5)
            .when(s_in, 6)
            .otherwise(0))


def merge_portfolio(target: DataFrame, updates: DataFrame, p: Params = DEFAULT,
                    gen: str = "gen2", log: DataFrame | None = None) -> DataFrame:
    """POR-6 / POR-7: fold the update set into the portfolio.

    gen2 clauses, first match wins: (1) SELL and held -> close at the current price;
    (2) BUY and flat -> open one lot at the signal price; (3) BUY and held -> add a lot,
    weighted-average entry; (4) other match -> refresh price and unrealized PnL;
    (5) new ticker with BUY -> open one lot; (6) new ticker -> flat row.
    gen1: matched -> refresh; new ticker with BUY -> open; anything else ignored.

    With ``p.gate_on_new_signal`` (and ``log`` given), clauses 1-3 and 5 act only on a
    signal not yet in the log, so re-running a step does not buy again.
    """
    lot = p.buy_shares
    target = schemas.conform(target, schemas.PORTFOLIO)
    u = updates
    if p.gate_on_new_signal and log is not None:
        fresh = new_trades(updates, log).select("ticker", F.lit(True).alias("_fresh"))
        u = updates.join(fresh, "ticker", "left")
        act = F.when(F.col("_fresh").isNotNull(), F.col("last_signal"))
    else:
        act = F.col("last_signal")
    t = target.select("ticker", *[F.col(c).alias(f"t_{c}") for c in PORT_COLS if c != "ticker"],
                      F.lit(True).alias("_in_t"))
    s = u.select("ticker", F.col("current_price").alias("s_cp"), F.col("last_signal").alias("s_ls"),
                 act.alias("_s_sig"), F.col("signal_price").alias("s_sp"),
                 F.col("last_signal_time").alias("s_lt"), F.lit(True).alias("_in_s"))
    j = t.join(s, "ticker", "full_outer")
    return merge_columns(j, p, gen)


def merge_columns(j: DataFrame, p: Params = DEFAULT, gen: str = "gen2") -> DataFrame:
    """MERGE clause evaluation on a joined row with target columns ``t_*``, source
    columns ``s_cp / s_ls / s_sp / s_lt``, the acting label ``_s_sig`` and presence flags
    ``_in_t`` / ``_in_s``."""
    lot = p.buy_shares
    j = j.withColumn("_clause", merge_clause(gen))
    c = F.col("_clause")
    th, ta, tr, tt = F.col("t_holdings"), F.col("t_avg_entry_price"), F.col("t_realized_pnl"), F.col("t_total_trades")
    cp, sp = F.col("s_cp"), F.col("s_sp")
    new_h = th + lot
    new_avg = F.try_divide(ta * th + sp * lot, new_h)

    def case(default: str, **arms: Column) -> Column:
        e = None
        for k, v in arms.items():
            n = int(k[1:])
            e = F.when(c == n, v) if e is None else e.when(c == n, v)
        return e.otherwise(F.col(default)) if e is not None else F.col(default)

    if gen == "gen1":
        cols = {
            "holdings": case("t_holdings", c5=F.lit(lot).cast("long")),
            "avg_entry_price": case("t_avg_entry_price", c5=sp),
            "current_price": case("t_current_price", c4=cp, c5=cp),
            "unrealized_pnl": case("t_unrealized_pnl", c4=(cp - ta) * th, c5=(cp - sp) * lot),
            "realized_pnl": case("t_realized_pnl"),
            "total_trades": case("t_total_trades"),
            "last_signal": case("t_last_signal", c4=F.coalesce(F.col("s_ls"), F.col("t_last_signal")),
                                c5=F.col("s_ls")),
            "last_signal_time": case("t_last_signal_time",
                                     c4=F.coalesce(F.col("s_lt"), F.col("t_last_signal_time")),
                                     c5=F.col("s_lt")),
        }
        out = j.where(c.isNotNull()).select("ticker", *[v.alias(k) for k, v in cols.items()])
        return schemas.conform(out, schemas.PORTFOLIO_GEN1)

    trades_plus = F.coalesce(tt, F.lit(0)) + 1
    cols = {
        "holdings": case("t_holdings", c1=F.lit(0).cast("long"), c2=F.lit(lot).cast("long"),
                         c3=new_h, c5=F.lit(lot).cast("long"), c6=F.lit(0).cast("long")),
        "avg_entry_price": case("t_avg_entry_price", c2=sp, c3=new_avg, c5=sp, c6=F.lit(0.0)),
        "current_price": case("t_current_price", c1=cp, c2=cp, c3=cp, c4=cp, c5=cp, c6=cp),
        "unrealized_pnl": case("t_unrealized_pnl", c1=F.lit(0.0), c2=(cp - sp) * lot,
                               c3=(cp - new_avg) * new_h,
                               c4=F.when(th > 0, (cp - ta) * th).otherwise(F.lit(0.0)),
                               c5=(cp - sp) * lot, c6=F.lit(0.0)),
        "realized_pnl": case("t_realized_pnl", c1=F.coalesce(tr, F.lit(0.0)) + (cp - ta) * th,
                             c5=F.lit(0.0), c6=F.lit(0.0)),
        "total_trades": case("t_total_trades", c1=trades_plus, c2=trades_plus, c3=trades_plus,
                             c5=F.lit(1), c6=F.lit(0)),
        "last_signal": case("t_last_signal", c1=F.col("s_ls"), c2=F.col("s_ls"), c3=F.col("s_ls"),
                            c4=F.coalesce(F.col("s_ls"), F.col("t_last_signal")),
                            c5=F.col("s_ls"), c6=F.col("s_ls")),
        "last_signal_time": case("t_last_signal_time", c1=F.col("s_lt"), c2=F.col("s_lt"),
                                 c3=F.col("s_lt"),
                                 c4=F.coalesce(F.col("s_lt"), F.col("t_last_signal_time")),
                                 c5=F.col("s_lt"), c6=F.col("s_lt")),
    }
    out = j.select("ticker", *[v.alias(k) for k, v in cols.items()])
    return schemas.conform(out, schemas.PORTFOLIO)


def merge_clause_counts(target: DataFrame, updates: DataFrame, gen: str = "gen2") -> DataFrame:
    """How many rows each MERGE clause handled (for tests and run summaries)."""
    t = target.select("ticker", F.col("holdings").alias("t_holdings"), F.lit(True).alias("_in_t"))
    s = updates.select("ticker", F.col("last_signal").alias("_s_sig"), F.lit(True).alias("_in_s"))
    j = t.join(s, "ticker", "full_outer")
    return j.groupBy(merge_clause(gen).alias("clause")).agg(F.count(F.lit(1)).alias("rows"))


def ticker_snapshot(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per ticker: newest price, newest signal (POR-5) and the levels of the
    newest BUY with a stop (POR-2) -- two aggregations, no window over all rows."""
    price = latest_by_key(bars, ["close"]).select("ticker", F.col("close").alias("current_price"))
    is_lv = (F.col("signal") == "BUY") & F.col("stop_loss").isNotNull()
    sig = signals.groupBy("ticker").agg(
        F.max_by(F.struct("signal", "signal_score", "close", "stop_loss", "take_profit", "timestamp"),
                 F.struct("timestamp", "signal")).alias("_s"),
        F.max_by(F.struct("stop_loss", "take_profit"), F.when(is_lv, F.col("timestamp"))).alias("_lv"))
    sig = sig.select("ticker", F.col("_s.signal").alias("last_signal"), F.col("_s.signal_score").alias("signal_score"),
                     F.col("_s.close").alias("signal_price"), F.col("_s.stop_loss").alias("stop_loss"),
                     F.col("_s.take_profit").alias("take_profit"),
                     F.col("_s.timestamp").alias("last_signal_time"),
                     F.col("_lv.stop_loss").alias("lv_stop"), F.col("_lv.take_profit").alias("lv_take"))
    return price.join(sig, "ticker", "left")


def step_frame(portfolio: DataFrame, bars: DataFrame, signals: DataFrame, log: DataFrame,
               as_of: Column, p: Params = DEFAULT) -> DataFrame:
    """Everything one run needs, one row per ticker: the portfolio (full outer) joined
    with the ticker snapshot, exit decision applied to the target columns, and a flag
    for signals not yet in the log.

    The log is only probed on (ticker, label, time) of each ticker's newest signal; exit
    rows of this run carry STOP_LOSS / TAKE_PROFIT labels and cannot match a BUY / SELL
    key, so they need not be added to the log before the probe.
    """
    port = schemas.conform(portfolio, schemas.PORTFOLIO)
    t = port.select("ticker", *[F.col(c).alias(f"t_{c}") for c in PORT_COLS if c != "ticker"],
                    F.lit(True).alias("_in_t"))
    snap = ticker_snapshot(bars, signals)
    s = snap.select("ticker", F.col("current_price").alias("s_cp"), F.col("last_signal").alias("s_ls"),
                    F.col("signal_price").alias("s_sp"), F.col("last_signal_time").alias("s_lt"),
                    F.col("signal_score").alias("s_score"), F.col("stop_loss").alias("s_stop"),
                    F.col("take_profit").alias("s_take"), "lv_stop", "lv_take", F.lit(True).alias("_in_s"))
    j = t.join(s, "ticker", "full_outer")

    both = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull() & (F.col("t_holdings") > 0)
    cp = F.col("s_cp")
    hit_stop = both & (cp <= F.coalesce(F.col("lv_stop"), F.lit(p.no_stop_level)))
    hit_take = both & (cp >= F.coalesce(F.col("lv_take"), F.lit(p.no_take_level)))
    j = j.withColumn("x_reason", F.when(hit_stop, STOP_LOSS).when(hit_take, TAKE_PROFIT)) \
         .withColumn("x_pnl", (cp - F.col("t_avg_entry_price")) * F.col("t_holdings")) \
         .withColumn("x_qty", F.col("t_holdings"))
    hit = F.col("x_reason").isNotNull()
    closed = {
        "t_holdings": F.lit(0).cast("long"),
        "t_current_price": cp,
        "t_unrealized_pnl": F.lit(0.0),
        "t_realized_pnl": F.coalesce(F.col("t_realized_pnl"), F.lit(0.0)) + F.col("x_pnl"),
        "t_total_trades": F.coalesce(F.col("t_total_trades"), F.lit(0)) + 1,
        "t_last_signal": F.col("x_reason"),
        "t_last_signal_time": as_of,
    }
    j = j.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in closed.items()})

    # only the snapshot's own keys matter: one row a ticker, so the whole log isn't de-duplicated
    asked = j.where(F.col("s_ls").isNotNull()).select("ticker", "s_ls", "s_lt")
    keys = log.select("ticker", F.col("signal").alias("s_ls"), F.col("timestamp").alias("s_lt")) \
              .join(asked, ["ticker", "s_ls", "s_lt"], "left_semi").dropDuplicates(["ticker", "s_ls", "s_lt"]).withColumn("_logged", F.lit(True))
    j = j.join(keys, ["ticker", "s_ls", "s_lt"], "left")
    is_new = F.col("s_ls").isNotNull() & F.col("_logged").isNull()
    act = F.when(is_new, F.col("s_ls")) if p.gate_on_new_signal else F.col("s_ls")
    return j.withColumn("_is_new", is_new).withColumn("_s_sig", act)


def step_trade_rows(frame: DataFrame, as_of: Column, p: Params = DEFAULT) -> DataFrame:
    """Exit trades and new-signal trades from the step frame in one pass (an array of
    up to two trades per ticker, inlined), in the trade-log layout."""
    held = F.coalesce(F.col("t_holdings"), F.lit(0))
    sig = F.col("s_ls")
    exit_row = F.when(F.col("x_reason").isNotNull(), F.struct(
        F.col("x_reason").alias("signal"), F.lit(None).cast("double").alias("signal_score"),
        F.col("s_cp").alias("price"), F.col("x_qty").cast("long").alias("quantity"),
        F.col("x_pnl").alias("pnl_realized"), F.lit(None).cast("double").alias("stop_loss"),
        F.lit(None).cast("double").alias("take_profit"), as_of.alias("timestamp")))
    entry_row = F.when(F.col("_is_new"), F.struct(
        sig.alias("signal"), F.col("s_score").alias("signal_score"), F.col("s_sp").alias("price"),
        F.when(sig == "BUY", F.lit(p.buy_shares)).otherwise(held).cast("long").alias("quantity"),
        F.when((sig == "SELL") & (held > 0),
               (F.col("s_sp") - F.coalesce(F.col("t_avg_entry_price"), F.lit(0.0))) * F.col("t_holdings"))
         .otherwise(F.lit(0.0)).alias("pnl_realized"),
        F.col("s_stop").alias("stop_loss"), F.col("s_take").alias("take_profit"),
        F.col("s_lt").alias("timestamp")))
    trades = F.filter(F.array(exit_row, entry_row), lambda x: x.isNotNull())
    rows = frame.where(F.col("x_reason").isNotNull() | F.col("_is_new")) \
                .select("ticker", F.inline(trades))
    return to_trade_log(rows, as_of)


def step_new_trades(frame: DataFrame) -> DataFrame:
    """POR-8 from the step frame: the rows of ``new_trades`` without another derivation."""
    return frame.where("_is_new").select(
        "ticker", F.col("s_cp").alias("current_price"), F.col("s_ls").alias("last_signal"),
        F.col("s_score").alias("signal_score"), F.col("s_sp").alias("signal_price"),
        F.col("s_stop").alias("stop_loss"), F.col("s_take").alias("take_profit"),
        F.col("s_lt").alias("last_signal_time"))


def portfolio_step(portfolio: DataFrame, bars: DataFrame, signals: DataFrame, log: DataFrame,
                   as_of: Column, p: Params = DEFAULT,
                   materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """One run: exits, then the log entries for new signals, then the MERGE fold.

    Returns (new portfolio, trade-log rows to append), both derived from one per-ticker
    frame. With ``materialize`` that frame is checkpointed (reliably, to the shared
    checkpoint folder) so writing both outputs does not compute it twice.
    """
    frame = step_frame(portfolio, bars, signals, log, as_of, p)
    if materialize:
        frame = frame.checkpoint(eager=True)
    return merge_columns(frame, p, "gen2"), step_trade_rows(frame, as_of, p)
