"""Filtered, sorted pages of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Rows that meet all conditions; ``None`` stands for no condition."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def page(df: DataFrame, order: Sequence[Column], page_number: int = 1, size: int = 50) -> DataFrame:
    """Page ``page_number`` (from 1) of ``df`` in the given total order.

    For the first pages: the rows before it are sorted and skipped. Pages far
    behind are read with ``page_behind`` or from a list that ``write_ranked`` stored.
    """
    if page_number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    ordered = df.orderBy(*order)
    skipped = (page_number - 1) * size
    return (ordered.offset(skipped) if skipped else ordered).limit(size)


def page_after(df: DataFrame, order: Sequence[Column], after: Column, size: int = 50) -> DataFrame:
    """The page that starts behind a known row: ``after`` is true for rows behind it.

    Unlike an offset, the cost does not grow with the page number.
    """
    return df.where(after).orderBy(*order).limit(size)


def page_behind(
    df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence[Any], size: int = 50
) -> DataFrame:
    """The page behind a known row: ``order`` has columns and whether they descend, ``last`` its values.

    The filter on the first column reaches the scan. No column of the order may hold NULL.
    """
    ahead = F.lit(False)
    for (name, falls), value in reversed(list(zip(order, last, strict=True))):
        column = F.col(name)
        ahead = (column < value if falls else column > value) | ((column == value) & ahead)
    (name, falls), value = order[0], last[0]
    reach = F.col(name) <= value if falls else F.col(name) >= value
    return page_after(df, [F.col(n).desc() if down else F.col(n).asc() for n, down in order], reach & ahead, size)


def write_ranked(df: DataFrame, order: Sequence[Column], folder: str, partitions: int | None = None) -> None:
    """Stores a list in a total order, so that any of its pages can be read by itself.

    Rows are dealt out by ranges of the order and numbered within their range;
    an index has the number of rows before each range. No row passes the driver.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    number = F.monotonically_increasing_id()  # the range in the upper bits, the place in the lower 33
    rows = ranged.sortWithinPartitions(*order).withColumn("_number", number)
    rows.select(
        *df.columns, F.shiftright("_number", 33).cast("int").alias("_range"),
        F.col("_number").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    ).write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/rows")
    stored = df.sparkSession.read.schema(_ranked_schema(df.schema)).parquet(f"{folder}/rows")
    ends = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per range
    index = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(ends) - F.col("n"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")


def _ranked_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_place", LongType()), StructField("_range", IntegerType())])


def ranked_page(
    spark: SparkSession, folder: str, schema: StructType, page_number: int = 1, size: int = 50
) -> DataFrame:
    """Page ``page_number`` (from 1) of a stored list; only the ranges that hold it are read."""
    if page_number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    first = (page_number - 1) * size
    index = spark.read.schema("_range int, n bigint, before bigint").parquet(f"{folder}/index")
    held = index.where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
    before = {r["_range"]: r["before"] for r in held}
    rows = spark.read.schema(_ranked_schema(schema)).parquet(f"{folder}/rows")
    rank = F.lit(None).cast("bigint")
    for part, n in before.items():
        rank = F.when(F.col("_range") == part, F.col("_place") + n).otherwise(rank)
    ranked = rows.where(F.col("_range").isin(list(before))).withColumn("_rank", rank)
    page_rows = ranked.where((F.col("_rank") >= first) & (F.col("_rank") < first + size))
    return page_rows.orderBy("_rank").select(*schema.names)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    """Rows and pages of the filtered table."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("bigint")
    )
