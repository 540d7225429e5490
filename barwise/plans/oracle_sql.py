"""Independent SQL (DuckDB dialect) for every registered query.

The SQL is written from the operator definitions, not generated from the Spark plans,
so it checks them. Building blocks are CTE strings; ``with_ctes`` assembles them.
Doubles are rounded to 6 decimals on output, on both sides.
"""

from __future__ import annotations

from ..config import DEFAULT, GEN1, Params
from ..functions.indicators import level_factors
from ..sources import adapters as A


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def ts(x: str) -> str:
    return f"TIMESTAMP '{x}'"


def r6(select_sql: str, cols: list[str]) -> str:
    """Round the named double columns of a query to 6 decimals."""
    k = "CAST(1000000.0 AS DOUBLE)"
    rep = ", ".join(f"round({c} * {k}) / {k} + CAST(0.0 AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({select_sql}) AS _q"


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


# ---- adapters ------------------------------------------------------------------

EV = ("ev", "SELECT event_type, ts, value, user_id, "
            "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def bars_cte(name: str, minutes: int, offset: float = 0.0) -> tuple[str, str]:
    price = f"(value + {dbl(offset)})" if offset else "value"
    return (name, f"""
      SELECT event_type AS ticker, time_bucket(INTERVAL '{minutes} minutes', ts) AS timestamp,
             arg_min({price}, ts) AS open, max({price}) AS high, min({price}) AS low,
             arg_max({price}, ts) AS close, CAST(sum(k) AS BIGINT) AS volume
      FROM ev GROUP BY 1, 2""")


BARS_1H = bars_cte("bars_1h", 60)
BARS_5M = bars_cte("bars_5m", 5, 50.0)
BARS_10M = bars_cte("bars_10m", 10, 50.0)

USER_TICKS = ("user_ticks", f"""
  SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, ts AS timestamp, value AS open,
         value + CAST(k AS DOUBLE) / 10 AS high,
         greatest(value - ({dbl(99.0)} - CAST(k AS DOUBLE)) / 10, {dbl(0.005)}) AS low,
         value AS close, CAST(1 AS BIGINT) AS volume
  FROM ev""")

DIRTY_BARS = ("dirty_bars", """
  SELECT ticker, timestamp, open,
         CASE WHEN b % 79 = 0 THEN low * 0.5 ELSE high END AS high,
         CASE WHEN b % 89 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE low END AS low,
         CASE WHEN b % 97 = 0 THEN CAST(NULL AS DOUBLE) ELSE close END AS close,
         CASE WHEN b % 83 = 0 THEN CAST(-5 AS BIGINT) ELSE volume END AS volume
  FROM (SELECT *, CAST(floor(epoch(timestamp) / 600) AS BIGINT) AS b FROM bars_10m)""")

SYMBOL_DIM = ("symbol_dim", f"""
  SELECT upper(ticker) || '.EV' AS symbol, ticker
  FROM (SELECT DISTINCT event_type AS ticker FROM events UNION ALL SELECT '{A.ABSENT_SYMBOL}')""")

VENDOR_BARS = ("vendor_bars", """
  SELECT upper(ticker) || '.EV' AS symbol, timestamp AS "Datetime",
         CAST(open AS VARCHAR) AS "Open", CAST(high AS VARCHAR) AS "High",
         CAST(low AS VARCHAR) AS "Low",
         CASE WHEN CAST(floor(epoch(timestamp) / 300) AS BIGINT) % 97 = 0 THEN 'n/a'
              ELSE CAST(close AS VARCHAR) END AS "Close",
         CAST(volume AS VARCHAR) AS "Volume"
  FROM bars_5m""")

PORTFOLIO_PREV = ("portfolio_prev", """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker,
         CAST((user_id % 4) * 100 AS BIGINT) AS holdings,
         first_close AS avg_entry_price, first_close AS current_price,
         CAST(0.0 AS DOUBLE) AS unrealized_pnl,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS realized_pnl,
         CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS total_trades,
         CAST(NULL AS VARCHAR) AS last_signal, CAST(NULL AS TIMESTAMP) AS last_signal_time
  FROM (SELECT user_id, arg_min(value, ts) AS first_close FROM events GROUP BY user_id)
  WHERE user_id % 5 <> 0""")

TRADE_LOG = ("trade_log", """
  SELECT o_orderkey AS trade_id, o_orderpriority AS ticker,
         CASE WHEN o_custkey % 5 <= 1 THEN 'BUY' WHEN o_custkey % 5 = 2 THEN 'SELL'
              WHEN o_custkey % 5 = 3 THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS signal,
         CAST(NULL AS DOUBLE) AS signal_score, o_totalprice AS price,
         CAST(100 AS BIGINT) AS quantity,
         CASE WHEN o_custkey % 5 <= 1 THEN CAST(0.0 AS DOUBLE)
              ELSE CAST((o_custkey % 21) - 10 AS DOUBLE) * 1.5 END AS pnl_realized,
         CAST(NULL AS DOUBLE) AS stop_loss, CAST(NULL AS DOUBLE) AS take_profit,
         o_orderdate AS timestamp, CAST(NULL AS TIMESTAMP) AS created_at
  FROM orders""")


# ---- indicators and signals ----------------------------------------------------

def indicator_ctes(src: str, name: str = "ind", p: Params = DEFAULT) -> list[tuple[str, str]]:
    def rows(n: int) -> str:
        return f"(PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    # Frame sums add the frame's values first to last, as Spark's sliding frame does,
    # so both engines produce the same double (a tree-ordered sum can differ by an ulp).
    def rsum(x: str, n: int) -> str:
        return f"list_sum(list({x}) OVER {rows(n)})"

    def ravg(x: str, n: int) -> str:
        return f"(list_sum(list({x}) OVER {rows(n)}) / count({x}) OVER {rows(n)})"

    if p.warmup == "gated":
        s20 = f"CASE WHEN rn >= {p.sma_short} THEN s20 END"
        s50 = f"CASE WHEN rn >= {p.sma_long} THEN s50 END"
    else:
        s20, s50 = "s20", "s50"
    return [
        (f"{name}_b", f"""
          SELECT ticker, timestamp, high, low, close,
                 row_number() OVER (PARTITION BY ticker ORDER BY timestamp) AS rn,
                 lag(close) OVER (PARTITION BY ticker ORDER BY timestamp) AS pc,
                 lag(high) OVER (PARTITION BY ticker ORDER BY timestamp) AS ph,
                 lag(low) OVER (PARTITION BY ticker ORDER BY timestamp) AS pl
          FROM {src}"""),
        (f"{name}_t", f"""
          SELECT *, greatest(close - pc, 0.0) AS gain, greatest(-(close - pc), 0.0) AS loss,
                 greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
                 abs(high - pl) AS vmp, abs(low - ph) AS vmn
          FROM {name}_b"""),
        (f"{name}_r", f"""
          SELECT ticker, timestamp, close, rn,
                 {ravg("close", p.sma_short)} AS s20,
                 {ravg("close", p.sma_long)} AS s50,
                 {ravg("gain", p.rsi_period)} AS ag,
                 {ravg("loss", p.rsi_period)} AS al,
                 {rsum("tr", p.vortex_period)} AS trs,
                 {rsum("vmp", p.vortex_period)} AS vps,
                 {rsum("vmn", p.vortex_period)} AS vns
          FROM {name}_t"""),
        (name, f"""
          SELECT ticker, timestamp, close,
                 {s20} AS sma20, {s50} AS sma50,
                 CASE WHEN rn >= {p.rsi_min_rows} THEN
                   CASE WHEN al > 0 THEN 100.0 - 100.0 / (1.0 + ag / al) ELSE 100.0 END END AS rsi,
                 CASE WHEN rn >= {p.vortex_min_rows} AND trs > 0 THEN vps / trs END AS vortex_positive,
                 CASE WHEN rn >= {p.vortex_min_rows} AND trs > 0 THEN vns / trs END AS vortex_negative
          FROM {name}_r"""),
    ]


IND_COLS = ["close", "sma20", "sma50", "rsi", "vortex_positive", "vortex_negative"]
SIG_DOUBLES = ["signal_score", "close", "sma20", "sma50", "rsi", "vortex_positive",
               "vortex_negative", "stop_loss", "take_profit"]
SIG_SELECT = ("ticker, timestamp, signal, signal_score, close, sma20, sma50, rsi, "
              "vortex_positive, vortex_negative, stop_loss, take_profit")


def buy_sql(p: Params = DEFAULT) -> str:
    return (f"sma20 > sma50 AND rsi IS NOT NULL AND rsi < {dbl(p.rsi_overbought)} "
            f"AND vortex_positive IS NOT NULL AND vortex_positive > vortex_negative")


def sell_sql(p: Params = DEFAULT) -> str:
    return (f"sma20 IS NOT NULL AND sma50 IS NOT NULL AND rsi IS NOT NULL "
            f"AND vortex_positive IS NOT NULL AND vortex_negative IS NOT NULL AND "
            f"((CASE WHEN sma20 < sma50 THEN 1 ELSE 0 END) + "
            f"(CASE WHEN rsi > {dbl(p.rsi_overbought)} THEN 1 ELSE 0 END) + "
            f"(CASE WHEN vortex_positive < vortex_negative THEN 1 ELSE 0 END)) >= 2")


def score_sql(p: Params = DEFAULT) -> str:
    def clamp(x: str) -> str:
        return f"greatest(0.0, least(100.0, {x}))"

    def parts(sma_diff: str, rsi_dist: str, vdiff: str) -> str:
        cap, span, vcap = dbl(p.score_sma_cap_pct), dbl(p.score_rsi_span), dbl(p.score_vortex_cap)
        a = clamp(f"least(({sma_diff}) / sma50 * 100, {cap}) / {cap} * 100")
        b = clamp(f"greatest(0.0, ({rsi_dist}) / {span}) * 100")
        c = clamp(f"least({vdiff}, {vcap}) / {vcap} * 100")
        return f"round({dbl(p.w_sma)} * {a} + {dbl(p.w_rsi)} * {b} + {dbl(p.w_vortex)} * {c}, 1)"

    buy = parts("sma20 - sma50", f"{dbl(p.rsi_overbought)} - rsi", "vortex_positive - vortex_negative")
    sell = parts("sma50 - sma20", f"rsi - {dbl(p.rsi_oversold)}", "vortex_negative - vortex_positive")
    missing = " OR ".join(f"{c} IS NULL" for c in
                          ["sma20", "sma50", "rsi", "vortex_positive", "vortex_negative"])
    return (f"coalesce(CASE WHEN {missing} THEN 0.0 WHEN signal = 'BUY' THEN {buy} "
            f"WHEN signal = 'SELL' THEN {sell} END, 0.0)")


def signal_ctes(ind: str = "ind", name: str = "sig", p: Params = DEFAULT) -> list[tuple[str, str]]:
    f = level_factors(p)
    return [
        (f"{name}_l", f"""
          SELECT *, CASE WHEN {buy_sql(p)} THEN 'BUY' WHEN {sell_sql(p)} THEN 'SELL' END AS signal
          FROM {ind}"""),
        (name, f"""
          SELECT ticker, timestamp, signal, {score_sql(p)} AS signal_score, close, sma20, sma50,
                 rsi, vortex_positive, vortex_negative,
                 CASE WHEN signal = 'BUY' THEN round(close * {dbl(f['buy_stop'])}, 4)
                      ELSE round(close * {dbl(f['sell_stop'])}, 4) END AS stop_loss,
                 CASE WHEN signal = 'BUY' THEN round(close * {dbl(f['buy_take'])}, 4)
                      ELSE round(close * {dbl(f['sell_take'])}, 4) END AS take_profit
          FROM {name}_l WHERE signal IS NOT NULL"""),
    ]
