"""The whole analysis of one scan, step by step into stored tables.

Each step writes its table before the next one reads it. That cuts the
lineage, so a lost executor repeats one step at most, and a job that is run
again replaces the partitions of its scan instead of adding to them. Snapshots
and forecasts are kept per scan and date, so those of other dates stay, and the
stored snapshots are the history that the next run forecasts from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from stowage.operators import (
    breakdowns, duplicates, folders, forecasting, recommendations, snapshots, staleness, workspaces,
)
from stowage.sources.tables import read_table, replace_partitions

STEPS = [
    "scored_files", "folders", "workspaces", "file_hashes", "duplicate_groups",
    "duplicate_members", "recommendations", "snapshots", "forecasts",
]


def run_analysis(
    spark: SparkSession,
    files: DataFrame,
    hashed: DataFrame,
    scans: DataFrame,
    history: DataFrame | None,
    output: str,
    scan_id: str,
    as_of: str,
    capacity_bytes: int | None = None,
    free_bytes: int | None = None,
    volume_id: str = "all",
) -> DataFrame:
    """Analyses a completed scan and returns the rows stored per table, counted while they are written.

    ``hashed`` holds the digests of the scan's candidate files. ``history`` are
    daily snapshots of other volumes, if there are any; those of ``volume_id``
    come from the store, this run's included. A scan that is not completed is refused.
    """
    register = breakdowns.of_scan(scans, scan_id).where(F.col("status").startswith("completed"))
    if register.limit(1).count() == 0:
        raise ValueError(f"scan {scan_id} is not completed")

    counts: dict[str, int] = {}

    def store(df: DataFrame, name: str, *more: str) -> DataFrame:
        """Replaces the scan's rows of a table, by none if there are none, and reads them back."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        counted = df.observe(seen, F.count(F.lit(1)).alias("row_count"))
        replace = [scan_id] if not more else []
        replace_partitions(counted, f"{output}/{name}", "scan_id", *more, replacing=replace)
        counts[name] = seen.get["row_count"]
        return breakdowns.of_scan(read_table(df, f"{output}/{name}"), scan_id)

    own = breakdowns.of_scan(files, scan_id)
    scored = store(staleness.score_files(own, as_of), "scored_files")
    rollup = store(folders.folder_rollup(scored), "folders")
    spaces = workspaces.with_activity(
        workspaces.workspaces(workspaces.artifact_files(scored)), as_of
    )
    spaces = store(workspaces.with_project_bytes(spaces, rollup), "workspaces")
    digests = store(breakdowns.of_scan(hashed, scan_id), "file_hashes")
    groups = store(duplicates.duplicate_groups(digests), "duplicate_groups")
    members = store(duplicates.duplicate_members(digests), "duplicate_members")

    date = as_of[:10]
    made = snapshots.snapshot(scored, rollup, register, scan_id, date, capacity_bytes, free_bytes)
    made = made.withColumn("volume_id", F.lit(volume_id))
    snap = store(made, "snapshots", "snapshot_date").where(F.col("snapshot_date") == F.lit(date).cast("date"))
    free = snap.select(
        "scan_id",
        F.greatest(F.col("total_size_bytes") - F.col("used_size_bytes"), F.lit(0))
        .alias("free_storage"),
    )
    series = ["volume_id", "snapshot_date", "total_size_bytes", "used_size_bytes", "file_count", "dir_count"]
    past = read_table(made, f"{output}/snapshots").where(F.col("snapshot_date") <= F.lit(date).cast("date"))
    past = snapshots.one_per_day(past.select(*series, "scan_id")).select(*series)
    if history is not None:
        past = past.unionByName(history.select(*series))
    growth = snapshots.growth_rate(past).agg(
        F.lit(scan_id).alias("scan_id"), F.sum("daily_growth_bytes").alias("daily_growth_bytes")
    )
    contexts = recommendations.context(groups, members, scored, spaces, free, growth)
    store(recommendations.recommendations(contexts), "recommendations")

    # Series with fewer than two snapshots give nothing to forecast from.
    points = forecasting.series_points(past)
    fitted = forecasting.forecasts(points, date).where("point_count > 1")
    made = forecasting.one_model(fitted).withColumns(
        {"scan_id": F.lit(scan_id), "forecast_date": F.lit(date).cast("date")})
    store(made, "forecasts", "forecast_date")
    return spark.createDataFrame([(name, counts[name]) for name in STEPS], "table_name string, row_count bigint")
