"""A stored folder rollup that is kept up to date from the deltas of later scans.

Folders lie in one partition per top-level folder. An update reads the delta
and the partitions it touches, and replaces just these, whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.operators.folders import ROLLUP, apply_changes, rollup_changes
from stowage.sources.commits import STAGED, Store, recover
from stowage.sources.tables import read_table, replace_partitions

_SCHEMA = "path string, total_size_bytes bigint, file_count bigint, dir_count bigint, area string"
#: The partition of the root itself.
TOP = "_"


def area_of(path: Column) -> Column:
    """The top-level folder that a folder lies in."""
    return F.coalesce(F.nullif(F.split(path, "/")[1], F.lit("")), F.lit(TOP))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(folder)


def write_rollup(rollup: DataFrame, folder: str) -> None:
    """Stores the rollup of a whole scan as the first state."""
    replace_partitions(rollup.select(*ROLLUP, area_of(F.col("path")).alias("area")), folder, "area")


def read_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder).select(*ROLLUP)


def update_rollup(spark: SparkSession, folder: str, delta: DataFrame) -> list[str]:
    """Adds a delta, as ``inventory_delta`` gives it, and returns the names of the replaced partitions."""
    recover(spark, folder)
    # One row per changed folder, kept so that the inventories are compared once.
    kept = f"{folder}/{STAGED}/changes-{uuid.uuid4().hex}"
    changes = rollup_changes(delta)
    changes.write.parquet(kept)
    changes = read_table(changes, kept)
    touched = changes.select(area_of(F.col("path")).alias("area")).distinct()
    areas = [r["area"] for r in touched.collect()]  # top-level folders, as many as partitions at most
    stored = _read(spark, folder).where(F.col("area").isin(areas)).select(*ROLLUP)
    after = apply_changes(stored, changes)
    replace_partitions(
        after.withColumn("area", area_of(F.col("path"))), folder, "area", replacing=areas)
    Store(spark, folder).remove(STAGED, kept.rpartition("/")[2])
    return areas
