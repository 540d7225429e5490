"""Vectorised indicator kernel used inside the stream's per-ticker state update.

It is the numpy twin of ``operators.indicators``: frame sums add the frame's values
first to last (as Spark's sliding frame does), so stream and batch give the same
doubles. Nulls (NaN) are skipped as Spark's aggregates do. It only ever sees one state bucket's micro-batch plus at most
``state_rows`` rows of state for each of its tickers, so its memory is bounded.
"""

from __future__ import annotations

import numpy as np

from ..config import DEFAULT, Params


def window_sum(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = x[i-w+1] + ... + x[i], added in order; NaN where the frame is short."""
    n = len(x)
    out = np.full(n, np.nan)
    if n >= w:
        m = n - w + 1
        acc = x[0:m].copy()
        for k in range(1, w):
            acc = acc + x[k:k + m]
        out[w - 1:] = acc
    return out


def window_total(x: np.ndarray, w: int) -> np.ndarray:
    """``window_sum`` as Spark's SUM over a frame: nulls (NaN) are skipped, a frame without
    a value is NaN."""
    gap = np.isnan(x)
    if not gap.any():
        return window_sum(x, w)
    n = window_sum((~gap).astype(float), w)
    return np.where(n > 0, window_sum(np.where(gap, 0.0, x), w), np.nan)


def window_mean(x: np.ndarray, w: int) -> np.ndarray:
    """Spark's AVG over a full frame: the mean of the values that aren't null."""
    gap = np.isnan(x)
    if not gap.any():
        return window_sum(x, w) / w
    n = window_sum((~gap).astype(float), w)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, window_sum(np.where(gap, 0.0, x), w) / n, np.nan)


def indicator_arrays(high: np.ndarray, low: np.ndarray, close: np.ndarray, first_n: int | np.ndarray,
                     p: Params = DEFAULT, place: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Indicators for every row of (history + new rows); ``first_n`` is the global
    1-based row number of element 0. Values are NaN where a gate is not met.

    With ``place`` the rows are those of several tickers, one after the other: each row's
    place (from 0) among its ticker's, and ``first_n`` is given for each row. No frame
    reaches back over its ticker's first row."""
    if place is None:
        place = np.arange(len(close))
    n, first = first_n + place, place == 0

    def before(x: np.ndarray) -> np.ndarray:
        return np.where(first, np.nan, np.concatenate([[np.nan], x[:-1]])[:len(x)])

    def whole(x: np.ndarray, w: int) -> np.ndarray:
        return np.where(place >= w - 1, x, np.nan)

    pc, ph, pl = before(close), before(high), before(low)
    delta = close - pc
    gain = np.fmax(delta, 0.0)  # an unknown change counts as none, as in the batch plan
    loss = np.fmax(-delta, 0.0)
    tr = np.fmax(high - low, np.fmax(np.abs(high - pc), np.abs(low - pc)))
    vmp = np.abs(high - pl)
    vmn = np.abs(low - ph)

    sma_s = whole(window_mean(close, p.sma_short), p.sma_short)
    sma_l = whole(window_mean(close, p.sma_long), p.sma_long)
    ag = whole(window_mean(gain, p.rsi_period), p.rsi_period)
    al = whole(window_mean(loss, p.rsi_period), p.rsi_period)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(al > 0, 100.0 - 100.0 / (1.0 + ag / al), 100.0)
        trs = whole(window_total(tr, p.vortex_period), p.vortex_period)
        vp = np.where(trs > 0, window_total(vmp, p.vortex_period) / trs, np.nan)
        vn = np.where(trs > 0, window_total(vmn, p.vortex_period) / trs, np.nan)
    nan = np.nan
    return {
        "sma20": np.where(n >= p.sma_short, sma_s, nan),
        "sma50": np.where(n >= p.sma_long, sma_l, nan),
        "rsi": np.where((n >= p.rsi_min_rows) & ~np.isnan(al), rsi, nan),
        "vortex_positive": np.where(n >= p.vortex_min_rows, vp, nan),
        "vortex_negative": np.where(n >= p.vortex_min_rows, vn, nan),
    }
