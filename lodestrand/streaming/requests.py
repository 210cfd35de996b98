"""Event streams of requests: events of a request are appended in order until one ends it or nothing follows for a while.

An event has a kind: ``final`` and ``error`` end the request, so does a null; any other kind goes on.  What comes after an end, or
after more than ``idle`` of silence, is the request's next session.  Events may arrive out of order within ``delay``: they wait in the
state until the watermark has passed them and are appended by (time, event).  State is a list of waiting events and one of
appended events for each request, with timers for the first of those and for the silence after the last of these, so a request that nothing
follows is closed without an event.  A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestrand.operators.shared import shared_dir

#: Kinds that end a request; the silence that does, in seconds.
ENDS, IDLE_SECONDS = ("final", "error"), 300
STATE = "ms long, event long, kind string"
SESSIONS = "request string, session int, started_ms long, ended_ms long, n_events int, events array<long>, outcome string"
#: Fixed values: (event type, step, kind) of the events that the table of events stands for.
TAXONOMY = (("view", "supervisor/route", "trace"), ("click", "tool/search", "trace"), ("purchase", "supervisor/answer", "final"), ("error", "agent/failed", "error"), ("signup", "agent/done", None))


class Sessions(StatefulProcessor):
    """Appends the events of each request and gives out its sessions as they end."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.appended = handle.getListState("waiting", STATE), handle.getListState("appended", STATE)
        self.closed = handle.getValueState("closed", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            kinds = [None if pd.isna(k) else k for k in part["kind"]]
            self.waiting.appendList(list(zip(part["ms"].astype(int).tolist(), part["event"].astype(int).tolist(), kinds, strict=True)))
            self.handle.registerTimer(int(part["ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2])
        due = [e for e in waiting if e[0] <= mark]
        was_open = [tuple(e) for e in self.appended.get()]
        number = self.closed.get()[0] if self.closed.exists() else 0
        open_, out = list(was_open), []

        def end(outcome: str, at: int) -> None:
            nonlocal number
            out.append((key[0], number, open_[0][0], at, len(open_), [e[1] for e in open_], outcome))
            number += 1
            open_.clear()

        for event in due:
            if open_ and event[0] - open_[-1][0] > self.idle_ms:
                end("timeout", open_[-1][0] + self.idle_ms)
            open_.append(event)
            if event[2] is None or event[2] in ENDS:
                end(event[2] or "null", event[0])
        if open_ and open_[-1][0] + self.idle_ms < mark:
            end("timeout", open_[-1][0] + self.idle_ms)
        if due:
            self._put(self.waiting, waiting[len(due) :])
        if open_ != was_open:
            self._put(self.appended, open_)
        if out:
            self.closed.update((number,))
        if len(due) < len(waiting):
            self.handle.registerTimer(waiting[len(due)][0])
        if open_:
            self.handle.registerTimer(open_[-1][0] + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSIONS.split(", ")])

    @staticmethod
    def _put(state, events: list[tuple]) -> None:
        if events:
            state.put(events)
        else:
            state.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, idle_seconds: int = IDLE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Stream of ended sessions of a stream of events (request, event, ts, kind)."""
    rows = events.select(F.col("request").cast("string").alias("request"), "event", F.col("ts").cast("timestamp").alias("ts"), "kind").where("ts is not null")
    rows = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("request").transformWithStateInPandas(Sessions(idle_seconds * 1000), SESSIONS, "Append", "eventTime")


def run_sessions(spark: SparkSession, events: DataFrame, at: str | None = None, idle_seconds: int = IDLE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Work off what the stream ``events`` holds by now, and return all sessions that have ended so far.

    at: folder of the stream's state and results; a later call with the same folder goes on where this one ended.
    """
    at = at or shared_dir(spark)
    provider, kept = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def store(batch: DataFrame, number: int) -> None:  # writing a batch again replaces it
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = sessions(events, idle_seconds, delay).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(store).start()
    finally:
        spark.conf.set(provider, kept)
    query.awaitTermination()
    return spark.read.schema(SESSIONS).parquet(f"{at}/out").select(*[c.split()[0] for c in SESSIONS.split(", ")])
