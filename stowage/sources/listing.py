"""Inventories from real folders, by Spark's own file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.functions.paths import normalize_path, with_path_parts


def _plain(path: Column) -> Column:
    """A listed address without its scheme, as an absolute path."""
    return F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")


def list_files(spark: SparkSession, root: str, scan_id: str) -> DataFrame:
    """All files below ``root`` that are not empty, in the layout of an inventory.

    Spark's file source lists in parallel and opens no file. It leaves out empty
    and hidden files and follows links, so folders with links to themselves
    need an inventory that comes as a table.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(_plain(F.col("path")).alias("path"), F.col("length").alias("size_bytes"),
                F.col("modificationTime").alias("modified_at"))
    )
    rows = with_path_parts(listed.withColumn("path", normalize_path(F.col("path"))))
    return rows.select(
        F.lit(scan_id).alias("scan_id"),
        F.sha2("path", 256).alias("file_id"),
        "path", "directory", "filename", "extension", "size_bytes", "category",
        F.lit(None).cast("timestamp").alias("created_at"),
        "modified_at",
        # Listings know no access time; without this every file would look unused.
        F.col("modified_at").alias("accessed_at"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(None).cast("string").alias("permissions"),
    )
