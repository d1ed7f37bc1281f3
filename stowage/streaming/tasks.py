"""The last state of every task of an event stream, kept only while it may change.

State holds one row per running task. A terminal event sets a timer; when no
event of the task has come for a while after it, the task's only output row is
written and its state goes. Tasks that fall silent without an end are closed
by a longer timer, so state is bounded by the tasks that are at work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stowage.fixed_values import TERMINAL_EVENTS
from stowage.session import shared_folder, use_utc
from stowage.sources.given_tables import task_events_of
from stowage.streaming.jobs import stream_table

_STATE = "event_id bigint, event_type string, micros bigint, files_per_second double, event_count bigint"
OUTPUT = ("task_id string, event_id bigint, event_type string, ended_micros bigint, files_per_second double, "
          "event_count bigint, is_terminal boolean")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastState(StatefulProcessor):
    """Newest event by number, and how many there were, until a timer closes the task."""

    def __init__(self, grace_ms: int, idle_ms: int):
        self.grace_ms, self.idle_ms = grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = tuple(self.newest.get()) if self.newest.exists() else None
        count = last[4] if last else 0
        for row in rows:
            count += 1
            if last is None or row["event_id"] >= last[0]:
                last = (row["event_id"], row["event_type"], row["micros"], row["files_per_second"], 0)
        if last is None:
            return iter(())
        self.newest.update((*last[:4], count))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = self.grace_ms if last[1] in TERMINAL_EVENTS else self.idle_ms
        self.handle.registerTimer(last[2] // 1000 + wait)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        event, kind, micros, rate, count = tuple(self.newest.get())
        self.newest.clear()
        yield Row(task_id=key[0], event_id=event, event_type=kind, ended_micros=micros, files_per_second=rate,
                  event_count=count, is_terminal=kind in TERMINAL_EVENTS)

    def close(self) -> None:
        pass


def last_states(
    events: DataFrame, lateness: str = "1 hour", grace_ms: int = 3_600_000, idle_ms: int = 7 * 86_400_000
) -> DataFrame:
    """One row per ended task of a stream of task events, written once no event may change it.

    An event that comes after its task was closed opens it anew, with a row of
    its own. Events older than ``lateness`` behind the newest one are left out.
    Its query must be started within ``state_in_rocksdb``.
    """
    rows = events.withWatermark("ts", lateness).select(
        "task_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("micros"),
        F.col("files_per_second").cast("double").alias("files_per_second"))
    return rows.groupBy("task_id").transformWithState(
        statefulProcessor=LastState(grace_ms, idle_ms), outputStructType=OUTPUT,
        outputMode="Append", timeMode="EventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started and state read within keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def task_state_stream(
    events: DataFrame, output: str, checkpoint: str, lateness: str = "1 hour",
    grace_ms: int = 3_600_000, idle_ms: int = 7 * 86_400_000, once: bool = False,
) -> StreamingQuery:
    """Appends each ended task to ``output``; a restarted job goes on where it stopped."""
    writer = (
        last_states(events, lateness, grace_ms, idle_ms).writeStream.outputMode("append").format("parquet")
        .option("path", output).option("checkpointLocation", checkpoint)
    )
    with state_in_rocksdb(events.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def running_tasks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest event of each task whose state a stream still keeps."""
    with state_in_rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
        return state.select("key.task_id", "value.*")


def ended_tasks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over the given events to its end and returns the tasks that ended."""
    use_utc(spark)
    folder = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    events = task_events_of(stream_table(spark, f"{sf_dir}/events.parquet*", files_per_trigger=100_000))
    running = task_state_stream(events, f"{folder}/out", f"{folder}/state", once=True)
    running.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")
