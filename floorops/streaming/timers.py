"""Streams with event-time timers by key: sessions that a rating closes, and stalled tasks with two deadlines.

They run on ``transformWithState``, so the session needs the RocksDB state
store: ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Sessions(StatefulProcessor):
    """Waiting rows until the watermark has passed them, and the open session: (start, last, n, until) in microseconds.

    Rows are taken in order of time and tie once no earlier row can come, so
    the order in which they arrive does not matter. One timer a key is set, for
    the first waiting row or for the end of the session's pause.
    """

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, tie long, closes boolean")
        self.session = handle.getValueState("session", "start long, last long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for p in rows for x in zip(_micros(p["ts"]), p["tie"].tolist(), p["closes"].tolist(), strict=True)]
        if new:
            self.waiting.appendList(new)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key: tuple, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        now = tuple(self.session.get()) if self.session.exists() else None
        done = []
        for ts, _, closes in [r for r in rows if r[0] <= passed]:
            if now and ts - now[1] >= self.gap:
                done.append((*now, False))
                now = None
            if closes:
                if now:
                    done.append((*now, True))
                now = None
            else:
                now = (now[0], ts, now[2] + 1) if now else (ts, ts, 1)
        rest = [r for r in rows if r[0] > passed]
        if now and now[1] + self.gap <= passed:
            done.append((*now, False))
            now = None
        for state, value in ((self.session, now), (self.waiting, rest)):
            if value:
                state.put(value) if state is self.waiting else state.update(value)
            elif state.exists():
                state.clear()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        due = [rest[0][0]] if rest else []
        due += [now[1] + self.gap] if now else []
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        if done:
            start, last, n, closed = zip(*done, strict=True)
            yield pd.DataFrame({"channel": key[0], "user": key[1], "start": pd.to_datetime(start, unit="us"), "last": pd.to_datetime(last, unit="us"), "n": n, "closed": closed})

    def close(self) -> None:
        pass


def stream_rated_sessions(stream: DataFrame, gap: int = 600, delay: str = "1 hour") -> DataFrame:
    """Sessions (channel, user, start, last, n, closed) of rows (channel, user, ts, tie, closes), each once it has ended.

    A pause of ``gap`` seconds ends a session, and so does a row that
    ``closes`` (a good rating), which counts for no message itself. Rows later
    than ``delay`` are dropped. Equal to ``logs.sessionize(closes=...)`` of
    the same rows.
    """
    rows = stream.select("channel", "user", "ts", F.col("tie").cast("long").alias("tie"), F.coalesce("closes", F.lit(False)).alias("closes")).filter("ts is not null").withWatermark("ts", delay)
    out = "channel string, user string, start timestamp, last timestamp, n long, closed boolean"
    return rows.groupBy("channel", "user").transformWithStateInPandas(Sessions(gap), out, "append", "EventTime")


class Deadlines(StatefulProcessor):
    """Per task the time of its last update, and a timer for each deadline after it."""

    def __init__(self, minutes: tuple[int, ...]):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ts long")

    def due(self, since: int, minutes: int) -> int:
        return since // 1000 + minutes * 60_000 + 1  # the first millisecond that is more than so many minutes later

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last, status = _micros(rows["ts"])[-1], rows["status"].iloc[-1]
        if self.since.exists() and self.since.get()[0] > last:
            return iter(())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.since.update((last,))
        if status == "in_progress":
            for m in self.minutes:
                self.handle.registerTimer(self.due(last, m))
        else:
            # kept until the watermark has passed it, so that an older row cannot bring the task back
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0]
        at = expiredTimerInfo.getExpiryTimeInMs()
        hours = (timerValues.getCurrentWatermarkInMs() - since // 1000) // 3_600_000
        reached = [m for m in self.minutes if self.due(since, m) == at]
        if not [t for t in self.handle.listTimers() if t > at]:
            self.since.clear()
        if reached:
            yield pd.DataFrame({"task_id": [key[0]], "since": pd.to_datetime([since], unit="us"), "minutes": reached, "idle_hours": [hours]})

    def close(self) -> None:
        pass


def stream_stalled(stream: DataFrame, minutes: tuple[int, ...] = (15, 120), delay: str = "1 minute") -> DataFrame:
    """Tasks in progress that the watermark finds without an update for over 15 minutes, and again for over 2 hours.

    From rows (task_id, status, updated_at, created_at), the time of creation
    standing in for a missing update: (task_id, since, minutes, idle_hours), a
    row for each deadline that passes, with the whole hours that the task has
    been idle then. An update sets all deadlines anew; a task that is no longer
    in progress has none. What is due at a watermark is what
    ``records.stalled`` finds at that time.
    """
    ts = F.coalesce(F.col("updated_at"), F.col("created_at"))
    rows = stream.select("task_id", "status", ts.alias("ts")).filter("ts is not null").withWatermark("ts", delay)
    return rows.groupBy("task_id").transformWithStateInPandas(Deadlines(minutes), "task_id long, since timestamp, minutes int, idle_hours long", "append", "EventTime")
