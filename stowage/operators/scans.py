"""The scan register: totals of a scan, lists and lookups, deltas between scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.operators.breakdowns import of_scan
from stowage.operators.paging import where_all


#: The two ways in which a scan ends well.
COMPLETED = ["completed", "completed_with_warnings"]


def scan_order() -> list[Column]:
    return [F.col("created_at").desc(), F.col("scan_id")]


def list_scans(scans: DataFrame, status: str | None = None) -> DataFrame:
    return where_all(scans, [None if status is None else F.col("status") == status])


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    return of_scan(scans, scan_id)


def latest_completed(scans: DataFrame, per_root: bool = False) -> DataFrame:
    """The completed scan that ended last, overall or for each root path."""
    columns = [c for c in scans.columns if c not in ("completed_at", "scan_id")]
    last = F.max(F.struct("completed_at", "scan_id", *columns)).alias("_last")
    done = scans.where(F.col("status").isin(COMPLETED) & F.col("completed_at").isNotNull())
    picked = done.groupBy("root_path").agg(last) if per_root else done.agg(last)
    return picked.where(F.col("_last").isNotNull()).select("_last.*")


def of_latest_completed(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """The rows of the scan that ended last, which reports show where no scan is named."""
    return rows.join(latest_completed(scans).select("scan_id"), "scan_id", "left_semi")


def scan_totals(files: DataFrame, folders: DataFrame, scans: DataFrame) -> DataFrame:
    """Files, folders, bytes, rate and final status of each scan of the register.

    A scan without files has zeros, and one that has not ended keeps its status.
    """
    file_sums = files.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size_bytes").alias("total_size_bytes")
    )
    folder_sums = folders.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_dirs"))
    seconds = (
        F.unix_micros("completed_at") - F.unix_micros("started_at")
    ) / F.lit(1_000_000.0)
    return (
        scans.select("scan_id", "started_at", "completed_at", "error_count", "status")
        .join(file_sums, "scan_id", "left")
        .join(folder_sums, "scan_id", "left")
        .select(
            "scan_id",
            F.coalesce("total_files", F.lit(0)).alias("total_files"),
            F.coalesce("total_dirs", F.lit(0)).alias("total_dirs"),
            F.coalesce("total_size_bytes", F.lit(0)).alias("total_size_bytes"),
            F.when(seconds > 0, F.round(F.coalesce("total_files", F.lit(0)) / seconds, 1))
            .otherwise(0.0).alias("files_per_second"),
            F.when(~F.col("status").isin(COMPLETED), F.col("status"))
            .when(F.col("error_count") > 0, COMPLETED[1])
            .otherwise(COMPLETED[0]).alias("status"),
        )
    )


def inventory_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, changed, unchanged and gone files between two scans, by path."""
    old = before.select(
        "path", F.col("size_bytes").alias("old_size_bytes"),
        F.col("modified_at").alias("old_modified_at"), F.lit(True).alias("_was"),
    )
    new = after.select("path", "size_bytes", "modified_at", F.lit(True).alias("_is"))
    same = F.col("modified_at").eqNullSafe(F.col("old_modified_at")) & F.col(
        "size_bytes"
    ).eqNullSafe(F.col("old_size_bytes"))
    return old.join(new, "path", "full_outer").withColumn(
        "change",
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "gone")
        .when(same, "unchanged")
        .otherwise("changed"),
    ).drop("_was", "_is")


def delta_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("change").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(
            F.coalesce("size_bytes", F.lit(0)) - F.coalesce("old_size_bytes", F.lit(0))
        ).alias("bytes_difference"),
    )
