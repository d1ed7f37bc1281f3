"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from stowage.session import shared_folder, use_utc

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ADAPTIVE_BROADCASTS = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def appended(df: DataFrame, *names: str) -> DataFrame:
    """Frees the names of result columns: an input column of such a name gives way to the result."""
    return df.drop(*names)


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that none of the taken ones is, whatever its case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def free_prefix(prefix: str, taken: Iterable[str]) -> str:
    """The start of column names with which none of the taken ones begins."""
    held = [t.lower() for t in taken]
    while any(t.startswith(prefix) for t in held):
        prefix += "_"
    return prefix


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``.

    A table written here cuts lineage: a lost executor repeats the step that
    reads it, not those that made it. Tables that later steps don't need are
    removed with ``drop``. Without ``adaptive_broadcasts``, joins whose sides
    are shuffled already stay so in the writes: no small side is gathered in the driver.
    """

    def __init__(self, spark: SparkSession, name: str, adaptive_broadcasts: bool = True):
        self.spark = spark
        self.settings = {_CLEANUP: "true"} | ({} if adaptive_broadcasts else {_ADAPTIVE_BROADCASTS: "-1"})
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and returns it as read back, with the schema it was written with.

        The shuffle files of the write go with it, instead of waiting for the
        driver to collect its garbage: nothing but the written table is read later.
        """
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in self.settings}
        try:
            for key, value in self.settings.items():
                conf.set(key, value)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            for key, value in before.items():
                conf.set(key, value) if value is not None else conf.unset(key)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
