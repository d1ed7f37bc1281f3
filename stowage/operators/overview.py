"""The storage overview: every headline number of a scan in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stowage.operators.breakdowns import of_scan
from stowage.operators.scans import latest_completed


def merge_by_scan(parts: list[DataFrame], defaults: dict[str, Column]) -> DataFrame:
    """Puts one-row-per-scan aggregates side by side.

    The parts are stacked and grouped once, instead of being joined one after
    the other. Scans without a value get the default.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in stacked.columns if c != "scan_id"]
    grouped = stacked.groupBy("scan_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns]
    )
    return grouped.select(
        "scan_id",
        *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c)
          for c in columns],
    )


def overview(
    scored: DataFrame,
    folders: DataFrame,
    groups: DataFrame,
    spaces: DataFrame,
    scan_id: str,
    capacity_bytes: int,
    last_scan_at: str | None = None,
    scans: DataFrame | None = None,
) -> DataFrame:
    """Capacity, use, counts and recoverable bytes of one scan; zeros if it is empty.

    One aggregate over the scored files gives all that concerns files. The time
    of the last scan comes from the register ``scans``, if it is given.
    """
    spark = scored.sparkSession
    blank = spark.range(1).select(F.lit(scan_id).alias("scan_id"))
    merged = merge_by_scan(
        [
            blank,
            of_scan(scored, scan_id).groupBy("scan_id").agg(
                F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("used_storage"),
                F.sum(F.when(F.col("is_stale"), F.col("size_bytes"))).alias("stale_files_size"),
            ),
            of_scan(folders, scan_id).groupBy("scan_id").agg(F.count(F.lit(1)).alias("dir_count")),
            of_scan(groups, scan_id).groupBy("scan_id").agg(
                F.sum("wasted_bytes").alias("duplicate_waste")
            ),
            of_scan(spaces, scan_id).groupBy("scan_id").agg(
                F.sum("recoverable_bytes").alias("workspace_recoverable")
            ),
        ],
        {
            name: F.lit(0).cast("bigint")
            for name in (
                "file_count", "used_storage", "dir_count", "duplicate_waste",
                "stale_files_size", "workspace_recoverable",
            )
        },
    )
    last = F.lit(last_scan_at).cast("string")
    if scans is not None:
        done = latest_completed(scans).select(
            F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        last = F.coalesce(last, done.scalar())
    return merged.select(
        "scan_id",
        F.lit(capacity_bytes).cast("bigint").alias("total_storage"),
        "used_storage",
        F.greatest(F.lit(capacity_bytes) - F.col("used_storage"), F.lit(0))
        .cast("bigint").alias("free_storage"),
        "file_count",
        "dir_count",
        "duplicate_waste",
        "stale_files_size",
        "workspace_recoverable",
        (F.col("duplicate_waste") + F.col("stale_files_size") + F.col("workspace_recoverable"))
        .alias("recovery_opportunities"),
        last.alias("last_scan_at"),
    )


def storage_health(row: DataFrame) -> DataFrame:
    """Free space in whole percent, the low and critical flags and a headline class."""
    ratio = F.floor(F.col("free_storage") / F.col("total_storage") * 100 + F.lit(0.5))
    percent = F.when(F.col("total_storage") == 0, 0).otherwise(ratio).cast("bigint")
    analysed = (
        (F.col("duplicate_waste") > 0)
        | (F.col("stale_files_size") > 0)
        | (F.col("recovery_opportunities") > 0)
    )
    return row.select("*", percent.alias("free_percent")).select(
        "scan_id",
        "free_percent",
        (F.lit(100) - F.col("free_percent")).alias("used_percent"),
        (F.col("free_percent") < 10).alias("is_low"),
        (F.col("free_percent") < 5).alias("is_critical"),
        F.when(F.col("free_percent") < 5, "almost_full")
        .when(F.col("free_percent") < 10, "low_space")
        .when(analysed & (F.col("recovery_opportunities") > 0), "recoverable")
        .when(analysed, "healthy")
        .otherwise("scanned").alias("headline"),
    )
