"""Streaming throttle: per-key window state with event-time expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS_OUT = 10_000  # rows of one frame that leaves the processor


class ThrottleProcessor(StatefulProcessor):
    """State per key is two numbers: when the open window resets and how many events it saw."""

    def __init__(self, key: str, tie: str, limit: int, window_us: int) -> None:
        self.key, self.tie, self.limit, self.window_us = key, tie, limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "reset_us bigint, seen bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows of one key in one micro-batch, decided in event-time order: two arrays, sorted once.

        Windows begin where a search for the end of the last one lands, so steps are windows, not rows.
        """
        chunks = [(c["t_us"].to_numpy(np.int64), c[self.tie].to_numpy()) for c in rows]
        times, ties = (np.concatenate(part) for part in zip(*chunks))
        order = np.lexsort((ties, times))
        times, ties = times[order], ties[order]
        reset, seen = self.state.get() if self.state.exists() else (int(times[0]), 0)
        at = int(np.searchsorted(times, reset, side="left"))
        numbers, starts = np.arange(1, len(times) + 1), np.full(len(times), reset - self.window_us)
        numbers[:at] += seen
        seen += at
        while at < len(times):
            end = int(np.searchsorted(times, times[at] + self.window_us, side="left"))
            starts[at:end] = times[at]
            numbers[at:end] = np.arange(1, end - at + 1)
            reset, seen, at = int(times[at]) + self.window_us, end - at, end
        self.state.update((reset, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(reset // 1000 + 1)
        allowed = numbers <= self.limit
        wait = pd.Series(-(-(starts + self.window_us - times) // 1_000_000), dtype="Int64").mask(allowed)
        for a in range(0, len(times), ROWS_OUT):
            cut = slice(a, a + ROWS_OUT)
            yield pd.DataFrame({
                self.key: key[0], self.tie: ties[cut], "window_start_us": starts[cut], "request_no": numbers[cut], "allowed": allowed[cut],
                "retry_after": wait[cut].array,
            })

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form of the throttle, one decision per event; events later than the watermark
    are dropped. Needs the RocksDB state store provider.

    State is constant per key, and the rows of a key in one task are those of one micro-batch,
    which the source's rate option bounds.
    """
    kinds = dict(events.dtypes)
    rows = events.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", watermark)
    rows = rows.select(key, tie, "event_time", F.unix_micros("event_time").alias("t_us"))
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, window_start_us bigint, request_no bigint, allowed boolean, retry_after bigint"
    processor = ThrottleProcessor(key, tie, limit, window_seconds * 1_000_000)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")
