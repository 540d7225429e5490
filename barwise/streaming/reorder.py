"""STR-1 with a watermark: late bars are put in order inside the state.

Bars wait in a ``MapState`` (time -> prices) until the watermark has passed them; an event-time
timer at the ticker's earliest waiting bar fires then. So the rolling window takes them in
time order whatever order they came in, as long as none is later than the watermark's delay.
A bar repeated within the delay replaces the waiting one. Spark drops bars behind the
watermark before they reach the state; ``jobs.late_new_bars`` finds those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Params
from .processor import IND_COLS, TAIL_SCHEMA, _to_us
from .rolling import indicator_arrays

WAITING_KEY = "us long"
WAITING = "ms long, high double, low double, close double"
#: The ticker of a row that only moves the watermark on (see ``jobs.land_close``).
CLOSE = "__close__"


class ReorderingProcessor(StatefulProcessor):
    """Input: ticker, timestamp, high, low, close and ``event_ms``, the watermark column in ms."""

    def __init__(self, p: Params = DEFAULT):
        p.state_rows  # rejects a state shorter than the windows before the stream starts
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", TAIL_SCHEMA)
        self.waiting = handle.getMapState("waiting", WAITING_KEY, WAITING)
        self.timer = handle.getValueState("timer", "ms long")

    def _wake_at(self, ms: int, mark: int) -> None:
        """One timer for each ticker: when the watermark passes its earliest waiting bar."""
        wanted, held = max(ms, mark) + 1, self.timer.get()
        if held is None or wanted < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == CLOSE:
            return
        mark, first = timerValues.getCurrentWatermarkInMs(), None
        for chunk in rows:
            times = zip(_to_us(chunk["timestamp"]).tolist(), chunk["event_ms"], chunk["high"], chunk["low"], chunk["close"])
            for us, ms, *prices in times:
                self.waiting.updateValue((us,), (int(ms), *(None if pd.isna(x) else float(x) for x in prices)))
                first = int(ms) if first is None else min(first, int(ms))
        if first is not None:
            self._wake_at(first, mark)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], v) for k, v in self.waiting.iterator())
        due = [x for x in held if x[1][0] < mark]
        self.timer.clear()
        later = [x[1][0] for x in held if x[1][0] >= mark]
        if later:
            self._wake_at(min(later), mark)
        if not due:
            return
        for us, _ in due:
            self.waiting.removeKey((us,))
        state = self.tail.get()
        hist = [np.zeros(0)] * 4 if state is None else [np.asarray(x, float if i else np.int64) for i, x in enumerate(state[:4])]
        old, seen = len(hist[0]), 0 if state is None else int(state[4])
        fresh = np.array([us for us, _ in due], np.int64)
        ts = np.concatenate([hist[0].astype(np.int64), fresh])
        high, low, close = (np.concatenate([hist[i], np.array([v[i] for _, v in due], float)]) for i in (1, 2, 3))
        values = indicator_arrays(high, low, close, seen - old + 1, self.p)
        keep = self.p.state_rows
        self.tail.update((ts[-keep:].tolist(), high[-keep:].tolist(), low[-keep:].tolist(), close[-keep:].tolist(),
                          seen + len(due)))
        out = pd.DataFrame({"ticker": key[0], "timestamp": fresh.astype("datetime64[us]"), "close": close[old:]})
        for c in IND_COLS:
            out[c] = values[c][old:]
        out["is_late"] = False
        yield out

    def close(self) -> None:
        pass
