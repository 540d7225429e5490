"""Run parameters: indicator windows, thresholds, weights and parity switches.

One frozen dataclass feeds every operator, so a value is stated once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # ---- fixed values (must equal the reference for identical results) ----
    sma_short: int = 20
    sma_long: int = 50
    rsi_period: int = 14
    vortex_period: int = 14
    rsi_overbought: float = 70.0
    rsi_oversold: float = 30.0
    buy_shares: int = 100
    stop_loss_pct: float = 0.03
    take_profit_pct: float = 0.06
    cooldown_bars: int = 3
    bar_interval_min: int = 10
    w_sma: float = 0.35
    w_rsi: float = 0.35
    w_vortex: float = 0.30
    score_sma_cap_pct: float = 5.0
    score_rsi_span: float = 40.0
    score_vortex_cap: float = 0.3
    max_bar_pct_change: float = 0.20
    extreme_bar_pct_change: float = 0.50
    min_valid_price: float = 0.01
    expected_bars_per_day: int = 39
    trading_days: int = 22
    min_bar_fraction: float = 0.7
    gap_threshold_minutes: int = 25
    stale_hours: float = 24.0
    gap_report_limit: int = 20
    no_stop_level: float = 0.0
    no_take_level: float = 999999.0
    # ---- parity switches (generation 2 is the default contract) ----
    # "gated": SMA is null until the window is full; "partial": mean of what exists.
    warmup: str = "gated"
    # first row (1-based) that gets a Vortex value: 16 in generation 2, 15 in generation 1.
    vortex_min_rows: int = 16
    # rows of history a stream keeps per ticker; None: as many as the windows need, and 5.
    tail_cap: int | None = None
    # only let the portfolio fold act on a signal not yet in the trade log (off = parity).
    gate_on_new_signal: bool = False
    # ---- execution ----
    # rows per (ticker, chunk) in the chunked indicator plan used by the batch runs: a
    # ticker with more rows is spread over several tasks instead of one.
    chunk_rows: int = 1_000_000
    # time bucket that spreads one ticker's rows when numbering them or carrying the
    # previous row ("day"; "hour" for very dense tickers)
    order_bucket: str = "day"

    @property
    def min_expected_bars(self) -> int:
        return int(self.expected_bars_per_day * self.trading_days * self.min_bar_fraction)

    @property
    def cooldown_seconds(self) -> int:
        return self.cooldown_bars * self.bar_interval_min * 60

    @property
    def rsi_min_rows(self) -> int:
        return self.rsi_period + 1

    @property
    def history_rows(self) -> int:
        """Longest look-back any indicator needs, in rows (current row included)."""
        return max(self.sma_long, self.rsi_period + 1, self.vortex_period + 1)

    @property
    def state_rows(self) -> int:
        """Rows of history a stream keeps per ticker; never fewer than the windows need."""
        rows = self.history_rows + 5 if self.tail_cap is None else self.tail_cap
        if rows < self.history_rows:
            raise ValueError(f"tail_cap must be >= {self.history_rows}, the longest window")
        return rows

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()

# Generation-1 behaviour: partial SMA warm-up, Vortex from row 15, 50-row tail.
GEN1 = Params(warmup="partial", vortex_min_rows=15, tail_cap=50)
