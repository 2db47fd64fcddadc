"""A quota of calls by key in a trailing window, with a cooldown after failures, as keyed state of a stream.

A call is allowed if its key does not cool down and had fewer than `limit` allowed calls in the `window` before it. An allowed call that fails
lets its key cool down; refused calls count for nothing. State is the times of the allowed calls that still count (never more than `limit`) and
the end of the cooldown. A timer on event time drops both when neither can matter any more, so idle keys hold no state.

Calls of one key are decided in the order of their times within a micro-batch, which bounds what a key has to sort; a call that comes in a
later micro-batch than calls of later times is decided as if it came at the latest of these. For input in the order of time the decisions
therefore do not depend on how it is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import LATE

#: State of stateful processors lives in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "key string, call long, called long, allowed boolean, release long"


class Quota(StatefulProcessor):
    """Rows (key, call, at, failed) with at in microseconds to rows of DECIDED; release is when the key is next free, the call's own time if it was."""

    def __init__(self, limit: int, window: int, cooldown: int):
        self.limit, self.window, self.cooldown = limit, window, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "at long")
        self.rest = handle.getValueState("rest", "until long, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = [at for (at,) in self.calls.get()] if self.calls.exists() else []
        until, latest = self.rest.get() if self.rest.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "call"])
        allowed, release = [], []
        for at, failed in zip(batch["at"].tolist(), batch["failed"].tolist(), strict=True):
            latest = now = max(at, latest)
            live = [t for t in live if now - t < self.window]
            free = max(until, live[0] + self.window if len(live) >= self.limit else 0)
            allowed.append(now >= free)
            release.append(max(now, free))
            if now >= free:
                live.append(now)
                if failed:
                    until = max(until, now + self.cooldown)
        self.calls.put([(t,) for t in live])
        self.rest.update((until, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-max(until, live[-1] + self.window if live else 0, latest + 1) // 1000))
        yield pd.DataFrame({"key": key[0], "call": batch["call"].to_numpy(), "called": batch["at"].to_numpy(), "allowed": allowed, "release": release})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        self.rest.clear()
        return iter(())


def quota(events: DataFrame, key: Column, call: Column, failed: Column, *, limit: int, window: int, cooldown: int, late: str = LATE) -> DataFrame:
    """key, call, called, allowed and release of each row of the stream events(ts, ...); window and cooldown in seconds."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.withWatermark("ts", late).select("ts", key.cast("string").alias("key"), call.cast("long").alias("call"), F.unix_micros("ts").alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"))
    return rows.groupBy("key").transformWithStateInPandas(Quota(limit, window * 1_000_000, cooldown * 1_000_000), DECIDED, "Update", "EventTime")
