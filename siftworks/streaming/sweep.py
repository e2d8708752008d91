"""The re-check state machine and the superseding log as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, ts timestamp, event_id long, verdict string, streak long, escalated boolean"
#: What a key is told as when nothing came for it for the whole of its time to live.
IDLE = "idle"


class Sweep(StatefulProcessor):
    """One streak a key. It ends by itself `ttl_ms` after the key's last check; with tell_idle a timer then brings a row of verdict IDLE."""

    def __init__(self, ttl_ms: int | None, tell_idle: bool):
        self.ttl_ms, self.tell_idle = ttl_ms, tell_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "streak long", self.ttl_ms)

    def _keep(self, streak: int, timers) -> None:
        self.streak.update((streak,))
        if self.tell_idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState, timerValues) -> None:
        self._keep(int(initialState["streak"].iloc[0]), timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = self.streak.get() if self.streak.exists() else None
        unsure = ~batch.verdict.isin(("stale", "live")).to_numpy()
        # How far back the last sure check lies; ahead of the first one the streak goes on from the state.
        at = np.arange(1, len(batch) + 1)
        last = np.maximum.accumulate(np.where(unsure, 0, at))
        streak = at - last + np.where(last == 0, int(before[0]) if before else 0, 0)
        self._keep(int(streak[-1]), timerValues)
        yield batch.assign(key=key[0], streak=streak, escalated=streak == 2)[["key", "ts", "event_id", "verdict", "streak", "escalated"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.streak.clear()
        yield pd.DataFrame({"key": [key[0]], "ts": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")], "event_id": pd.array([None], "Int64"), "verdict": [IDLE], "streak": [0], "escalated": [False]})

    def close(self) -> None:
        pass


def sweep_stream(checks: DataFrame, ttl_ms: int | None = None, first: DataFrame | None = None, tell_idle: bool = False) -> DataFrame:
    """checks (key, ts, event_id, verdict) to the same with streak (neither stale nor live so often in a row) and escalated (exactly the
    second). Within a batch checks of a key are taken in order of (ts, event_id); batches come in the order of the source.

    ttl_ms: a key's state goes so long after its last check, and its streak then starts anew; None keeps it. tell_idle: with ttl_ms,
    each key that goes is told once (verdict IDLE, ts: when). first: the streaks that a new query starts with (key, streak), one row a
    key, as last_streaks has them of a batch log; a query that goes on from its checkpoint ignores it. The state store must be
    RocksDB's (use_rocksdb). With ttl_ms the clock alone may bring rows, so a query with the trigger availableNow never ends by itself:
    run it on a processing-time trigger, or once."""
    if tell_idle and ttl_ms is None:
        raise ValueError("tell_idle needs ttl_ms")
    start = None if first is None else first.select("key", F.col("streak").cast("long").alias("streak")).groupBy("key")
    return checks.select("key", "ts", "event_id", "verdict").groupBy("key").transformWithStateInPandas(Sweep(ttl_ms, tell_idle), OUT, "Append", "ProcessingTime" if ttl_ms else "None", start)


def last_streaks(states: DataFrame, order: list[str]) -> DataFrame:
    """(key, streak) after the last check of each key in what sweep_states has made of a batch log: the state to start a stream with."""
    return states.groupBy("key").agg(F.max_by("streak", F.struct(*order)).alias("streak"))


def use_rocksdb(spark) -> None:
    """Keep the state of this session's streams in RocksDB, on disk, which states with time limits and timers ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch of records once to a log folder; the current view is history.current_records over it. A batch that is run
    again replaces itself alone: its folder is named by the checkpoint's query, so a query that starts anew, at batch 0, leaves
    what earlier ones wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "once"
        batch.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
