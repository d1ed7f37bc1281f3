"""Progress events of running tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.fixed_values import TERMINAL_EVENTS


def is_terminal(event_type: Column) -> Column:
    return event_type.isin(TERMINAL_EVENTS)


def task_progress(events: DataFrame) -> DataFrame:
    """The newest event of each task, with its rate to one decimal."""
    newest = F.max(F.struct("event_id", "event_type", "ts", "files_per_second"))
    return events.groupBy("task_id").agg(
        newest["event_id"].alias("event_id"),
        newest["event_type"].alias("event_type"),
        newest["ts"].alias("ts"),
        F.round(newest["files_per_second"], 1).alias("files_per_second"),
        is_terminal(newest["event_type"]).alias("is_terminal"),
        F.count(F.lit(1)).alias("event_count"),
    )


def events_after(events: DataFrame, task_id: str, last_event_id: int) -> DataFrame:
    """What a reader that has seen ``last_event_id`` still has to get."""
    return events.where(
        (F.col("task_id") == task_id) & (F.col("event_id") > last_event_id)
    ).withColumn("is_terminal", is_terminal(F.col("event_type")))


def progress_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and mean rate per task and time window; also for streams."""
    return events.groupBy(F.window("ts", width), "task_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.round(F.col("files_per_second") * 100).cast("bigint")).alias("_rate"),
        F.max("event_id").alias("last_event_id"),
    ).select(
        F.col("window.start").alias("window_start"),
        "task_id",
        "event_count",
        F.round(F.col("_rate") / F.lit(100.0) / F.col("event_count"), 1).alias("files_per_second"),
        "last_event_id",
    )
