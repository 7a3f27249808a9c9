"""Readings held per device until it has been silent for a while.

State is keyed by (site, device, access point) and lies in RocksDB, so it may outgrow the memory of an executor.
`session_buffer` holds one row per open buffer, a session window with its readings; no Python runs. `device_buffer` is
for stays over very many batches, where such a row would be written again with each of them: a key holds its readings as
a list that only grows at its end, and the spans of its open buffers. Every span has an event-time timer at its last
reading plus the idle time; an extended span moves its timer, so a timer that fires always closes a buffer. It costs
several calls between Python and the state per buffer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.schema import IDLE_SECONDS

BUFFERED = "site_id INT, device STRING, ap STRING, first_ts BIGINT, ts BIGINT, rssi DOUBLE"
KEYS = ["site_id", "device", "ap"]
# A closed buffer is released in frames of so many readings.
PIECE = 10_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which keyed lists and timers need; others are not touched."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def merged_spans(spans: Iterable[tuple[int, int]], idle: int) -> list[tuple[int, int]]:
    """Spans in order, those with a gap of at most `idle` put together."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first - out[-1][1] <= idle:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


class IdleBuffer(StatefulProcessor):
    """Appends the readings of a key; gives those of a span back, in order, once its idle time is over."""

    def __init__(self, idle: int, piece: int = PIECE):
        self.idle, self.piece = idle, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", "ts BIGINT, rssi DOUBLE")
        self.spans = handle.getListState("spans", "first BIGINT, last BIGINT")

    def _end(self, span: tuple[int, int]) -> int:
        return (span[1] + self.idle) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(s) for s in self.spans.get()]
        spans = list(before)
        for frame in rows:
            ts = frame["ts"].astype("int64")
            self.readings.appendList([(int(t), None if pd.isna(r) else float(r)) for t, r in zip(ts, frame["rssi"], strict=True)])
            spans += merged_spans(((int(t), int(t)) for t in ts.unique()), self.idle)
        now = merged_spans(spans, self.idle)
        ends, known = {self._end(s) for s in now}, {self._end(s) for s in before}
        for t in known - ends:
            self.handle.deleteTimer(t)
        for t in ends - known:
            self.handle.registerTimer(t)
        self.spans.put(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(s) for s in self.spans.get()]
        over = [s for s in spans if self._end(s) == due]
        still = [s for s in spans if self._end(s) != due]
        if not over:
            return
        (first, last), = over
        released, kept = [], []
        for ts, rssi in self.readings.get():
            (released if first <= ts <= last else kept).append((ts, rssi))
        if still:
            self.readings.put(kept)
            self.spans.put(still)
        else:
            self.readings.clear()
            self.spans.clear()
        released.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        for i in range(0, len(released), self.piece):
            part = released[i:i + self.piece]
            yield pd.DataFrame({"site_id": pd.Series([key[0]] * len(part), dtype="Int32"), "device": key[1], "ap": key[2],
                                "first_ts": first, "ts": [t for t, _ in part],
                                "rssi": pd.Series([r for _, r in part], dtype="Float64")})

    def close(self) -> None:
        pass


def device_buffer(s: DataFrame, idle_seconds: int = IDLE_SECONDS, delay: str | None = None) -> DataFrame:
    """(site_id, device, ap, first_ts, ts, rssi): the readings of every buffer that a silence has closed (append mode).

    A buffer is a stretch of a device's readings at an access point without a gap of more than `idle_seconds`; late
    readings within `delay` may join buffers. It is released when the watermark is past its last reading plus the idle
    time. Readings without time are left out. Start the query within `rocksdb_state`.
    """
    from footfall.streaming.operators import DELAY, with_event_time

    x = with_event_time(s.where("ts IS NOT NULL"), delay or DELAY)
    return x.groupBy(*KEYS).transformWithStateInPandas(
        IdleBuffer(int(idle_seconds)), outputStructType=BUFFERED, outputMode="append", timeMode="EventTime")


def session_buffer(s: DataFrame, idle_seconds: int = IDLE_SECONDS, delay: str | None = None) -> DataFrame:
    """The rows of `device_buffer`, by session windows."""
    from footfall.streaming.operators import DELAY, with_event_time

    x = with_event_time(s.where("ts IS NOT NULL"), delay or DELAY)
    w = F.session_window("event_time", f"{int(idle_seconds)} seconds")
    held = x.groupBy(*KEYS, w.alias("w")).agg(F.min("ts").alias("first_ts"), F.collect_list(F.struct("ts", "rssi")).alias("readings"))
    rows = held.select(*KEYS, "first_ts", F.inline(F.sort_array("readings")))
    return rows.select(F.col("site_id").cast("int").alias("site_id"), "device", "ap", "first_ts", "ts", "rssi")
