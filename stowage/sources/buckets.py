"""Tables in buckets of their keys, so that two of them join without a shuffle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _name(folder: str) -> str:
    return f"stowage_{hashlib.md5(folder.encode()).hexdigest()}"


def write_buckets(df: DataFrame, folder: str, keys: list[str], buckets: int) -> DataFrame:
    """Stores the rows in ``buckets`` buckets of their keys and returns the stored table.

    Nothing is shuffled: each task writes its own rows of each bucket. Repartition
    ``df`` by the keys beforehand where that gives too many small files.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    writer.option("path", folder).saveAsTable(_name(folder))
    return spark.table(_name(folder))


def read_buckets(
    spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int
) -> DataFrame:
    """A table that an earlier session stored, with its buckets."""
    if not spark.catalog.tableExists(_name(folder)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {_name(folder)} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(_name(folder))
