"""Streams that keep state by key: task states, status flips, and the index of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floorops.sources.store import write_chunks

_STATUS = {"complete": "done", "progress": "in_progress", "blocked": "blocked"}


def stream_transitions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Flips of an agent's online state from rows (event_id, agent_id, ts, online); agents begin offline.

    The state is one flag a key. Rows of a batch are taken in order of
    (ts, event_id); rows that come after a later batch are taken as they come.
    """

    def flips(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else False
        changed = rows["online"].to_numpy() != rows["online"].shift(fill_value=before).to_numpy()
        state.update((bool(rows["online"].iloc[-1]),))
        yield rows.loc[changed, ["event_id", "ts", "online"]].assign(agent_id=key[0])[["event_id", "agent_id", "ts", "online"]]

    rows = stream.select("event_id", "agent_id", "ts", F.col("online").cast("boolean").alias("online")).withWatermark("ts", delay)
    return rows.groupBy("agent_id").applyInPandasWithState(flips, "event_id long, agent_id string, ts timestamp, online boolean", "online boolean", "append", GroupStateTimeout.NoTimeout)


def stream_tasks(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Task states, kept current, from messages (task_id, time, id, kind); the last report by (time, id) decides.

    Unlike the batch fold, which knows the task table, a report makes a task
    that no message has requested.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at, last = state.get if state.exists else (None, None, None)
        for rows in batches:
            for r in rows.sort_values(["time", "id"]).itertuples():
                if r.kind == "request":
                    status = status or "pending"
                elif r.kind in _STATUS and (at is None or (r.time, r.id) >= (at, last)):
                    status, at, last = _STATUS[r.kind], r.time.to_pydatetime(), int(r.id)
        if status:
            state.update((status, at, last))
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "completed_at": pd.to_datetime([at if status == "done" else None])})

    rows = stream.withWatermark("time", delay)
    return rows.groupBy("task_id").applyInPandasWithState(fold, "task_id long, status string, completed_at timestamp", "status string, at timestamp, last long", "update", GroupStateTimeout.NoTimeout)


def stream_index(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, source: str = "source_file", index: str = "chunk_index", parts: int = 256):
    """A query that chunks new or changed documents and upserts their chunks into the folder ``target`` (``sources.store``).

    A document that now has no chunk loses its old ones. A batch rewrites only
    the parts of its own sources, and one that runs again changes nothing;
    ``store.read_chunks`` reads the folder.
    """

    def write(batch: DataFrame, no: int) -> None:
        write_chunks(chunk(batch), target, no, batch, parts, source, index)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
