"""Keyed state with event-time timers, kept in RocksDB: events of captures, and alerts of searches that fell silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

EVENTS = "source_code string, external_id string, captured_at timestamp, event_type string, old_value string, new_value string"
ALERTS = "search_id long, last_beat timestamp"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which these processors need: state on the executors' disks and change logs in the checkpoint, not on the heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _milliseconds(t: datetime | pd.Timestamp) -> int:
    return pd.Timestamp(t).value // 1_000_000


class CaptureEvents(StatefulProcessor):
    """Price changes and reactivations of a listing, from its last capture. Without a capture for `keep_days`, the state goes by a timer; the next capture then is a first one."""

    def __init__(self, keep_days: float | None = None):
        self.keep = None if keep_days is None else int(keep_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, price string, active boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, price, active = self.last.get() if self.last.exists() else (None, None, None)
        f = pd.concat(list(rows)).sort_values(["captured_at", "price"])
        stamp = f.captured_at.astype("datetime64[ns]").astype("int64")
        f = f[stamp >= at] if at is not None else f
        if f.empty:
            return
        text = f.price.map(str, na_action="ignore").astype(object).where(f.price.notna(), None)
        out = []
        for when, new, now in zip(f.captured_at, text, f.active.astype(bool), strict=True):
            if at is not None:
                if new != price:
                    out.append((*key, when, "PRICE_CHANGED", price, new))
                if now and active is False:
                    out.append((*key, when, "LISTING_REACTIVATED", None, None))
            at, price, active = pd.Timestamp(when).value, new, bool(now)
        self.last.update((at, price, active))
        if self.keep is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(at // 1_000_000 + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class StaleSearches(StatefulProcessor):
    """An alert with a search's last heartbeat once event time is `minutes` past it; COMPLETED or FAILED ends the watch, an alert too."""

    def __init__(self, minutes: float):
        self.wait = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "beat timestamp")

    def _drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beat, done = (self.last.get()[0] if self.last.exists() else None), False
        for f in rows:
            newest = f.beat_at.max()
            beat = newest if beat is None else max(pd.Timestamp(beat), pd.Timestamp(newest))
            done |= bool(f.status.isin(["COMPLETED", "FAILED"]).any())
        self._drop_timers()
        if done:
            self.last.clear()
        else:
            self.last.update((pd.Timestamp(beat).to_pydatetime(),))
            self.handle.registerTimer(max(_milliseconds(beat) + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (beat,) = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"search_id": [key[0]], "last_beat": [pd.Timestamp(beat)]})

    def close(self) -> None:
        pass


def capture_events(captures: DataFrame, late: str = "1 hour", keep_days: float | None = None) -> DataFrame:
    """PRICE_CHANGED and LISTING_REACTIVATED events of a stream of captures(source_code, external_id, captured_at, price decimal, active). Captures later than the watermark, or older than the state, are dropped."""
    rows = captures.withWatermark("captured_at", late).groupBy("source_code", "external_id")
    return rows.transformWithStateInPandas(CaptureEvents(keep_days), EVENTS, "Append", "EventTime")


def stale_alerts(beats: DataFrame, minutes: float = 30, late: str = "1 minute") -> DataFrame:
    """(search_id, last_beat) once no heartbeat came for so long in event time. beats(search_id, beat_at, status)."""
    return beats.withWatermark("beat_at", late).groupBy("search_id").transformWithStateInPandas(StaleSearches(minutes), ALERTS, "Append", "EventTime")
