"""Totals, breakdowns and top lists of an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.texts import percent_of, percent_text


def of_scan(df: DataFrame, scan_id: str | None) -> DataFrame:
    """Rows of one scan; on a table partitioned by scan only its folder is read."""
    return df if scan_id is None else df.where(F.col("scan_id") == scan_id)


def total_stats(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    return of_scan(files, scan_id).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def category_breakdown(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Bytes per category; a missing one joins ``other`` before grouping."""
    return (
        of_scan(files, scan_id)
        .groupBy(F.coalesce("category", F.lit("other")).alias("category"))
        .agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    )


def extension_totals(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    return (
        of_scan(files, scan_id)
        .where(F.col("extension").isNotNull())
        .groupBy("extension")
        .agg(F.sum("size_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("file_count"))
    )


def extension_breakdown(
    files: DataFrame, scan_id: str | None = None, limit: int = 20
) -> DataFrame:
    """The extensions with the most bytes."""
    return (
        extension_totals(files, scan_id).orderBy(F.col("total_bytes").desc(), "extension").limit(limit)
    )


def top_by(
    rows: DataFrame, value: str, tiebreak: list[str], limit: int, two_pass: bool = False
) -> DataFrame:
    """The ``limit`` rows with the largest values, ties broken by other columns; NULLs come last.

    With ``two_pass``, meant for stored tables that are sorted by the value, a
    first pass reads only the value column and finds the smallest value of the
    list; the second one reads the wide columns with that bound as a filter,
    which skips nearly all pages. Both give the same rows.
    """
    order = [F.col(value).desc_nulls_last(), *tiebreak]
    if not two_pass:
        return rows.orderBy(*order).limit(limit)
    bound = (
        rows.select(value)
        .orderBy(F.col(value).desc())
        .limit(limit)
        .agg(F.min(value).alias("bound"))
        .scalar()
    )
    enough = rows.select(value).where(F.col(value).isNotNull()).limit(limit).agg(
        F.count(F.lit(1)).alias("n")).scalar()
    kept = F.coalesce(F.col(value) >= bound, F.lit(False)) | (enough < limit)
    return rows.where(kept).orderBy(*order).limit(limit)


def largest_files(files: DataFrame, scan_id: str | None = None, limit: int = 100) -> DataFrame:
    rows = of_scan(files, scan_id).select(
        "file_id", "path", "filename", "extension", "size_bytes", "category", "modified_at"
    )
    return top_by(rows, "size_bytes", ["path", "file_id"], limit)


def largest_folders(folders: DataFrame, scan_id: str | None = None, limit: int = 50) -> DataFrame:
    """The folders with the most bytes below them, from a folder rollup."""
    return (
        of_scan(folders, scan_id)
        .select("path", "name", "total_size_bytes", "file_count", "depth")
        .orderBy(F.col("total_size_bytes").desc(), "path")
        .limit(limit)
    )


def folder_count(folders: DataFrame, scan_id: str | None = None) -> DataFrame:
    return of_scan(folders, scan_id).agg(F.count(F.lit(1)).alias("dir_count"))


def with_share(groups: DataFrame, value: str = "total_bytes") -> DataFrame:
    """Each group's share of the total, as a number and as text.

    The total is a scalar subquery over the groups, so no window has to bring
    all groups into one task.
    """
    total = groups.agg(F.coalesce(F.sum(value), F.lit(0)).alias("t")).scalar()
    return groups.withColumn("_total", total).select(
        *groups.columns,
        percent_of(F.col(value), F.col("_total")).alias("share_pct"),
        percent_text(F.col(value), F.col("_total")).alias("share_text"),
    )


def with_total_count(top: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Adds the number of all rows to each row of a top list."""
    return top.withColumn("total_count", all_rows.agg(F.count(F.lit(1)).alias("n")).scalar())
