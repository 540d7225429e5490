"""SQL oracle pieces for the portfolio queries (DuckDB dialect)."""

from __future__ import annotations

from ..config import DEFAULT, Params
from ..sources import adapters as A
from . import oracle_sql as O


def port_ctes(p: Params = DEFAULT) -> list[tuple[str, str]]:
    lot = p.buy_shares
    asof = O.ts(A.AS_OF)
    return [
        O.EV, O.USER_TICKS, *O.indicator_ctes("user_ticks", "uind"), *O.signal_ctes("uind", "usig"),
        O.PORTFOLIO_PREV,
        ("cp", """SELECT ticker, close AS current_price, timestamp FROM user_ticks
                  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) = 1"""),
        ("lv", """SELECT ticker, stop_loss, take_profit FROM usig
                  WHERE signal = 'BUY' AND stop_loss IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) = 1"""),
        ("trig", f"""
          SELECT p.ticker, p.holdings, p.avg_entry_price, p.realized_pnl, p.total_trades,
                 cp.current_price,
                 CASE WHEN cp.current_price <= coalesce(lv.stop_loss, {O.dbl(p.no_stop_level)}) THEN 'STOP_LOSS'
                      WHEN cp.current_price >= coalesce(lv.take_profit, {O.dbl(p.no_take_level)}) THEN 'TAKE_PROFIT'
                 END AS exit_reason,
                 (cp.current_price - p.avg_entry_price) * p.holdings AS exit_pnl
          FROM portfolio_prev p JOIN cp ON p.ticker = cp.ticker LEFT JOIN lv ON p.ticker = lv.ticker
          WHERE p.holdings > 0
            AND (cp.current_price <= coalesce(lv.stop_loss, {O.dbl(p.no_stop_level)})
                 OR cp.current_price >= coalesce(lv.take_profit, {O.dbl(p.no_take_level)}))"""),
        ("exits", f"""
          SELECT ticker, exit_reason AS signal, CAST(NULL AS DOUBLE) AS signal_score,
                 current_price AS price, CAST(holdings AS BIGINT) AS quantity, exit_pnl AS pnl_realized,
                 CAST(NULL AS DOUBLE) AS stop_loss, CAST(NULL AS DOUBLE) AS take_profit,
                 {asof} AS timestamp
          FROM trig"""),
        ("pa", f"""
          SELECT p.ticker,
                 CAST(CASE WHEN x.ticker IS NOT NULL THEN 0 ELSE p.holdings END AS BIGINT) AS holdings,
                 p.avg_entry_price,
                 CASE WHEN x.ticker IS NOT NULL THEN x.current_price ELSE p.current_price END AS current_price,
                 CASE WHEN x.ticker IS NOT NULL THEN 0.0 ELSE p.unrealized_pnl END AS unrealized_pnl,
                 CASE WHEN x.ticker IS NOT NULL THEN coalesce(p.realized_pnl, 0.0) + x.exit_pnl
                      ELSE p.realized_pnl END AS realized_pnl,
                 CAST(CASE WHEN x.ticker IS NOT NULL THEN coalesce(p.total_trades, 0) + 1
                      ELSE p.total_trades END AS INTEGER) AS total_trades,
                 CASE WHEN x.ticker IS NOT NULL THEN x.exit_reason ELSE p.last_signal END AS last_signal,
                 CASE WHEN x.ticker IS NOT NULL THEN {asof} ELSE p.last_signal_time END AS last_signal_time
          FROM portfolio_prev p LEFT JOIN trig x ON p.ticker = x.ticker"""),
        ("ls", """SELECT ticker, signal AS last_signal, signal_score, close AS signal_price, stop_loss,
                         take_profit, timestamp AS last_signal_time FROM usig
                  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC, signal DESC) = 1"""),
        ("upd", """SELECT cp.ticker, cp.current_price, ls.last_signal, ls.signal_score, ls.signal_price,
                          ls.stop_loss, ls.take_profit, ls.last_signal_time
                   FROM cp LEFT JOIN ls ON cp.ticker = ls.ticker"""),
        ("log_hist", f"""
          SELECT ticker, signal, signal_score, close AS price, CAST({lot} AS BIGINT) AS quantity,
                 CAST(0.0 AS DOUBLE) AS pnl_realized, stop_loss, take_profit, timestamp
          FROM usig WHERE timestamp < {O.ts(A.SPLIT_TS)}"""),
        ("logged", "SELECT * FROM log_hist UNION ALL BY NAME SELECT * FROM exits"),
        ("nt", """SELECT u.* FROM upd u WHERE u.last_signal IS NOT NULL AND NOT EXISTS (
                    SELECT 1 FROM logged l WHERE l.ticker = u.ticker AND l.signal = u.last_signal
                      AND l.timestamp = u.last_signal_time)"""),
        ("entries", f"""
          SELECT nt.ticker, nt.last_signal AS signal, nt.signal_score, nt.signal_price AS price,
                 CAST(CASE WHEN nt.last_signal = 'BUY' THEN {lot} ELSE coalesce(pa.holdings, 0) END AS BIGINT) AS quantity,
                 CASE WHEN nt.last_signal = 'SELL' AND coalesce(pa.holdings, 0) > 0
                      THEN (nt.signal_price - coalesce(pa.avg_entry_price, 0.0)) * pa.holdings
                      ELSE 0.0 END AS pnl_realized,
                 nt.stop_loss, nt.take_profit, nt.last_signal_time AS timestamp
          FROM nt LEFT JOIN pa ON nt.ticker = pa.ticker"""),
    ]


def merge_ctes(target: str, source: str, name: str = "mc") -> list[tuple[str, str]]:
    return [(f"{name}_j", f"""
      SELECT coalesce(t.ticker, s.ticker) AS ticker, t.holdings AS th, t.avg_entry_price AS ta,
             t.current_price AS tc, t.unrealized_pnl AS tu, t.realized_pnl AS tr,
             t.total_trades AS tt, t.last_signal AS tls, t.last_signal_time AS tlt,
             t.ticker IS NOT NULL AS t_in, s.ticker IS NOT NULL AS s_in, s.current_price AS cp,
             s.last_signal AS sls, s.signal_price AS sp, s.last_signal_time AS slt
      FROM {target} t FULL OUTER JOIN {source} s ON t.ticker = s.ticker""")]


def merge_sql(src: str, p: Params = DEFAULT) -> str:
    lot = p.buy_shares
    avg = f"(ta * th + sp * {lot}) / (th + {lot})"
    return f"""
      SELECT ticker,
             CAST(CASE clause WHEN 1 THEN 0 WHEN 2 THEN {lot} WHEN 3 THEN th + {lot}
                              WHEN 5 THEN {lot} WHEN 6 THEN 0 ELSE th END AS BIGINT) AS holdings,
             CASE clause WHEN 2 THEN sp WHEN 3 THEN {avg} WHEN 5 THEN sp WHEN 6 THEN 0.0
                         ELSE ta END AS avg_entry_price,
             CASE WHEN clause BETWEEN 1 AND 6 THEN cp ELSE tc END AS current_price,
             CASE clause WHEN 1 THEN 0.0 WHEN 2 THEN (cp - sp) * {lot}
                         WHEN 3 THEN (cp - {avg}) * (th + {lot})
                         WHEN 4 THEN CASE WHEN th > 0 THEN (cp - ta) * th ELSE 0.0 END
                         WHEN 5 THEN (cp - sp) * {lot} WHEN 6 THEN 0.0 ELSE tu END AS unrealized_pnl,
             CASE clause WHEN 1 THEN coalesce(tr, 0.0) + (cp - ta) * th WHEN 5 THEN 0.0
                         WHEN 6 THEN 0.0 ELSE tr END AS realized_pnl,
             CAST(CASE WHEN clause IN (1, 2, 3) THEN coalesce(tt, 0) + 1 WHEN clause = 5 THEN 1
                       WHEN clause = 6 THEN 0 ELSE tt END AS INTEGER) AS total_trades,
             CASE WHEN clause IN (1, 2, 3, 5, 6) THEN sls WHEN clause = 4 THEN coalesce(sls, tls)
                  ELSE tls END AS last_signal,
             CASE WHEN clause IN (1, 2, 3, 5, 6) THEN slt WHEN clause = 4 THEN coalesce(slt, tlt)
                  ELSE tlt END AS last_signal_time
      FROM (SELECT *, {clause_sql()} AS clause FROM {src})"""


def clause_sql(gen: str = "gen2") -> str:
    if gen == "gen1":
        return ("CASE WHEN t_in AND s_in THEN 4 WHEN s_in AND sls = 'BUY' THEN 5 "
                "WHEN t_in THEN 0 END")
    return ("CASE WHEN t_in AND s_in AND sls = 'SELL' AND th > 0 THEN 1 "
            "WHEN t_in AND s_in AND sls = 'BUY' AND th = 0 THEN 2 "
            "WHEN t_in AND s_in AND sls = 'BUY' AND th > 0 THEN 3 "
            "WHEN t_in AND s_in THEN 4 WHEN s_in AND sls = 'BUY' THEN 5 "
            "WHEN s_in THEN 6 ELSE 0 END")


def merge_gen1_sql(src: str, p: Params = DEFAULT) -> str:
    lot = p.buy_shares
    return f"""
      SELECT ticker,
             CAST(CASE clause WHEN 5 THEN {lot} ELSE th END AS BIGINT) AS holdings,
             CASE clause WHEN 5 THEN sp ELSE ta END AS avg_entry_price,
             CASE WHEN clause IN (4, 5) THEN cp ELSE tc END AS current_price,
             CASE clause WHEN 4 THEN (cp - ta) * th WHEN 5 THEN (cp - sp) * {lot}
                         ELSE tu END AS unrealized_pnl,
             CASE clause WHEN 4 THEN coalesce(sls, tls) WHEN 5 THEN sls ELSE tls END AS last_signal,
             CASE clause WHEN 4 THEN coalesce(slt, tlt) WHEN 5 THEN slt ELSE tlt END AS last_signal_time
      FROM (SELECT *, {clause_sql('gen1')} AS clause FROM {src}) WHERE clause IS NOT NULL"""
