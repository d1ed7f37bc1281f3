"""Reading and writing the store: one folder per table, one partition per scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.operators.breakdowns import of_scan
from stowage.sources import commits


#: The column of the batch in which a row arrived; a whole scan written at once is the first.
BATCH, FIRST_BATCH = "batch", -1
#: Bytes of a source file that one task sorts, at most where its row groups allow: they fit in memory.
SORTED_BYTES = 8 << 20


def read_inventory(spark: SparkSession, folder: str, scan_id: str | None = None) -> DataFrame:
    """Inventory rows as they arrived, for one scan only its partition."""
    return of_scan(spark.read.parquet(folder), scan_id)


def current_inventory(spark: SparkSession, folder: str, scan_id: str | None = None) -> DataFrame:
    """One row per path of a scan: the one that arrived last."""
    rows = read_inventory(spark, folder, scan_id)
    keys = ["scan_id", "path"]
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    last = F.max(F.struct(BATCH, *rest)).alias("_row")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*rest, BATCH)])


def replace_partitions(
    df: DataFrame, folder: str, *keys: str, replacing: Iterable[str] = ()
) -> None:
    """Writes the partitions present in ``df``, replacing what they held.

    ``replacing`` names values of the first key whose old rows go even if ``df``
    has none for them. Rows are written beside the table first, so ``df`` may
    read the partitions that it replaces, and a job that dies leaves the old
    rows or the new ones (see ``commits``). Writing the same scan again gives
    the same table, so a repeated run is safe.
    """
    store, change = commits.stage(df, folder, list(keys))
    commits.replace(store, change, keys[0], list(replacing))


def exists(spark: SparkSession, folder: str) -> bool:
    return commits.Store(spark, folder).exists()


def read_table(df: DataFrame, folder: str) -> DataFrame:
    """A stored table with the schema of ``df``, also one without any file."""
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_inventory(files: DataFrame, folder: str, by_size: bool = True) -> None:
    """Stores the files of their scans, in place of all that was stored of them.

    Sorting by size within each task makes row-group statistics useful to
    size filters, without a shuffle. Tasks are small, so that none spills.
    """
    rows = files.withColumn(BATCH, F.lit(FIRST_BATCH).cast("bigint"))
    rows = rows.sortWithinPartitions("scan_id", F.col("size_bytes").desc()) if by_size else rows
    spark = files.sparkSession
    name = "spark.sql.files.maxPartitionBytes"
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    with commits.setting(spark, name, str(min(SORTED_BYTES, given))):
        replace_partitions(rows, folder, "scan_id")


def add_arrivals(files: DataFrame, folder: str, batch: int, source: str = "stream") -> None:
    """Adds files that arrived in a batch to the same store; a batch delivered again replaces itself."""
    rows = files.withColumn(BATCH, F.lit(batch).cast("bigint"))
    commits.add(*commits.stage(rows, folder, ["scan_id"]), f"{source}-{batch}")


def append(df: DataFrame, folder: str) -> None:
    """Appends records; existing ones are never touched."""
    df.write.mode("append").parquet(folder)
