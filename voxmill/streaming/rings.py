"""Ordered state over streams: percentile of the last rows and exponential trend of each key, in event-time order.

A stream brings rows late and out of order. Each key buffers its rows until the watermark has passed them (a timer
fires then), takes them in order of time and number, and gives each with the percentile of its last ``width`` values
and the trend. State is bounded: the ring has ``width`` values, the trend one number, the buffer what lies
within the watermark's delay. Rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rings(StatefulProcessor):
    def __init__(self, key: str, width: int, q: float, alpha: float):
        self.key, self.width, self.q, self.alpha = key, width, q, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, number bigint, value double")
        self.ring = handle.getListState("ring", "value double")
        self.trend = handle.getValueState("trend", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for b in rows:
            if len(b):
                self.waiting.appendList([(int(u), int(n), float(v)) for u, n, v in zip(b["us"], b["number"], b["value"], strict=True)])
                latest = max(latest or 0, int(b["us"].max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)  # one for the batch's last row: what is older goes with it
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        cut = bisect.bisect_left(waiting, (mark,))
        ready, left = waiting[:cut], waiting[cut:]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if not ready:
            yield self._rows([])
            return
        ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        trend = self.trend.get()[0] if self.trend.exists() else None
        values = np.array([*ring, *(r[2] for r in ready)])
        pct = np.full(len(ready), np.nan)
        if len(values) >= self.width:  # all windows at once; the last ones end at the ready rows
            full = np.lib.stride_tricks.sliding_window_view(values, self.width)[-len(ready) :]
            pct[len(ready) - len(full) :] = np.percentile(full, 100 * self.q, axis=1)
        trends = []
        for _, _, value in ready:
            trend = value if trend is None else self.alpha * trend + (1 - self.alpha) * value
            trends.append(trend)
        self.ring.put([(v,) for v in values[-self.width :].tolist()])
        self.trend.update((trend,))
        out = [(key[0], r[1], None if p != p else p, s) for r, p, s in zip(ready, pct.tolist(), trends, strict=True)]
        yield self._rows(out)

    def _rows(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, "number", "pct", "trend"]).astype({"pct": "float64", "trend": "float64"})

    def close(self) -> None:
        pass


def rings(events: DataFrame, key: str, number: str, value: str, late: str = "2 hours", width: int = 20, q: float = 0.95, alpha: float = 0.9) -> DataFrame:
    """(key, number, pct, trend) of each row of a stream with event time ``at``; pct is null for the first rows of a key. Needs the state store ``PROVIDER``."""
    rows = events.withWatermark("at", late).select("at", F.unix_micros("at").alias("us"), F.col(key).alias(key), F.col(number).alias("number"), F.col(value).alias("value"))
    # rows without a key only move the watermark; naming the time keeps this filter above it
    rows = rows.where(F.col(key).isNotNull() | F.col("at").isNull())
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Rings(key, width, q, alpha), f"{key} {kind}, number bigint, pct double, trend double", "Append", "EventTime")
