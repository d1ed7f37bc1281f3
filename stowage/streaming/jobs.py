"""Streaming forms of the progress windows and of the two upserted tables.

State and output live in folders that all executors share, so a job that is
restarted goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.operators.progress import progress_windows
from stowage.operators.snapshots import upsert_snapshots
from stowage.session import shared_folder
from stowage.sources.tables import add_arrivals, exists, read_table, replace_partitions


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder or glob of parquet files as a stream, with the schema of a batch read."""
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def progress_stream(
    events: DataFrame, output: str, checkpoint: str, width: str = "1 hour",
    lateness: str = "1 hour", once: bool = False,
) -> StreamingQuery:
    """Writes each window once it is complete; later events count as too late."""
    windows = progress_windows(events.withWatermark("ts", lateness), width)
    writer = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress_updates(
    events: DataFrame, output: str, checkpoint: str, width: str = "1 hour",
    lateness: str = "7 days", once: bool = False,
) -> StreamingQuery:
    """Keeps the current state of every window, including those still open.

    A window's state goes once no event of it can come any more, which
    ``lateness`` says; its rows stay as they were written last.

    Each batch writes the windows it changed under its own number, so that a
    repeated batch replaces itself; ``latest_windows`` reads the newest state.
    """

    def write(batch: DataFrame, number: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(number)), output, "batch")

    writer = (
        progress_windows(events.withWatermark("ts", lateness), width)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_windows(spark: SparkSession, output: str) -> DataFrame:
    stored = spark.read.parquet(output)
    keys = ["window_start", "task_id"]
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), F.col("batch")).alias("_row")
    return stored.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def progress_windows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the window stream over the given events to its end."""
    from stowage.sources.given_tables import task_events_of
    from stowage.session import use_utc

    use_utc(spark)
    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    events = task_events_of(stream_table(spark, f"{sf_dir}/events.parquet*"))
    # A table's files come in any order, so no event of them is late.
    running = progress_updates(
        events, f"{folder}/out", f"{folder}/state", lateness="36500 days", once=True
    )
    running.awaitTermination()
    return latest_windows(spark, f"{folder}/out")


def inventory_stream(
    arrivals: DataFrame, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Adds arriving inventory rows to the store that ``write_inventory`` writes, too.

    ``current_inventory`` reads the newest row of each path.
    """

    def write(batch: DataFrame, number: int) -> None:
        add_arrivals(batch, output, number)

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def snapshot_stream(
    arrivals: DataFrame, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keeps one snapshot per volume and date, the newest replacing the others.

    A batch reads only the dates it brings, merges them and replaces just
    those partitions, whole or not at all.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = batch.limit(0)
        if exists(spark, output):  # the first batch finds no table yet
            dates = batch.select("snapshot_date").distinct()
            stored = read_table(batch, output).join(dates, "snapshot_date", "left_semi")
        rows = upsert_snapshots(stored.select(*batch.columns), batch)
        replace_partitions(rows, output, "snapshot_date")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
