"""STR-1/2: per-ticker rolling state as a typed ``StatefulProcessor``.

State per ticker: one entry of a typed ``MapState`` holding the last ``state_rows`` bars as
parallel arrays (time in microseconds, high, low, close) and the number of bars seen,
which keeps warm-up gates global. One read and one write per ticker and micro-batch. Tickers
are dealt into ``STATE_BUCKETS`` groups by their hash: a call of the processor takes a
group's bars at once, so that many tickers with few bars each don't cost a call, a frame and
an Arrow batch each. Each micro-batch is sorted by time; a bar not newer than the newest bar
already in state (or repeated in the batch) is *late*: it is emitted with
``is_late = true`` and null indicators instead of being mis-ordered into the history,
so the caller can recompute that ticker in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..config import DEFAULT, Params
from .rolling import indicator_arrays

OUTPUT = T.StructType(schemas.INDICATORS.fields + [T.StructField("is_late", T.BooleanType(), True)])
TAIL_SCHEMA = "ts_us array<long>, high array<double>, low array<double>, close array<double>, n long"
#: Groups of tickers (a checkpoint keeps its number).
STATE_BUCKETS = 1024
IND_COLS = ["sma20", "sma50", "rsi", "vortex_positive", "vortex_negative"]


def state_bucket(ticker: str = "ticker") -> Column:
    """A ticker's group."""
    return F.pmod(F.xxhash64(ticker), F.lit(STATE_BUCKETS)).cast("int")


def _to_us(ts: pd.Series) -> np.ndarray:
    return ts.values.astype("datetime64[us]").astype(np.int64)


class RollingIndicatorProcessor(StatefulProcessor):
    """Input: the bars of a group of tickers (``state_bucket``)."""

    def __init__(self, p: Params = DEFAULT):
        p.state_rows  # rejects a state shorter than the windows before the stream starts
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tails = handle.getMapState("tail", "ticker string", TAIL_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["ticker", "timestamp", "high", "low", "close"]] for r in rows], ignore_index=True)
        if batch.empty:
            return
        codes, tickers = pd.factorize(batch["ticker"], use_na_sentinel=False)
        # by ticker and time, rows without a time last
        batch = batch.iloc[np.lexsort((_to_us(batch["timestamp"]), batch["timestamp"].isna(), codes))]
        codes, ts = np.sort(codes), _to_us(batch["timestamp"])
        begin = np.searchsorted(codes, np.arange(len(tickers) + 1))
        tickers = [None if pd.isna(t) else t for t in tickers]
        held = [self.tails.getValue((t,)) for t in tickers]
        seen = np.array([s[4] if s else 0 for s in held], np.int64)
        lengths = np.array([len(s[0]) if s else 0 for s in held], np.int64)

        late = np.zeros(len(batch), dtype=bool)
        late[1:] = (ts[1:] == ts[:-1]) & (codes[1:] == codes[:-1])  # repeated key inside the batch
        newest = np.array([s[0][-1] if s and len(s[0]) else 0 for s in held], np.int64)
        late |= (lengths > 0)[codes] & (ts <= newest[codes])
        new = np.bincount(codes[~late], minlength=len(tickers))

        # each ticker's kept bars and after them its fresh ones
        size = lengths + new
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(tickers)), size)
        place = np.arange(len(of)) - first[of]
        is_old = place < lengths[of]

        def joined(old: int, fresh: np.ndarray, kind) -> np.ndarray:
            x = np.empty(len(of), kind)
            x[is_old] = np.concatenate([np.asarray(s[old], kind) for s in held if s] or [np.zeros(0, kind)])
            x[~is_old] = fresh[~late]
            return x

        times = joined(0, ts, np.int64)
        high, low, close = (joined(i, batch[c].to_numpy(dtype=float), float)
                            for i, c in enumerate(("high", "low", "close"), 1))
        values = indicator_arrays(high, low, close, (seen - lengths + 1)[of], self.p, place)

        out = batch[["ticker", "timestamp", "close"]].astype({"close": float})
        for c in IND_COLS:
            out[c] = np.nan
            out.loc[~late, c] = values[c][~is_old]
        out["is_late"] = late

        # keep only the last ``state_rows`` bars (state stays bounded whatever the batch size)
        for k, ticker in enumerate(tickers):
            if new[k] or held[k] is None:
                a, z = max(first[k], first[k] + size[k] - self.p.state_rows), first[k] + size[k]
                self.tails.updateValue((ticker,), (*(x[a:z].tolist() for x in (times, high, low, close)),
                                                   int(seen[k] + new[k])))
        yield out

    def close(self) -> None:
        pass
