"""Daily snapshots and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from stowage.operators.breakdowns import of_scan
from stowage.operators.overview import merge_by_scan


def category_extension_cube(files: DataFrame) -> DataFrame:
    """Files and bytes per scan, category and extension.

    One pass over the inventory; totals and both breakdowns come from it.
    """
    return files.groupBy(
        "scan_id", F.coalesce("category", F.lit("other")).alias("category"), "extension"
    ).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"))


def snapshot(
    files: DataFrame,
    folders: DataFrame,
    scans: DataFrame,
    scan_id: str,
    snapshot_date: str,
    capacity_bytes: int | None = None,
    free_bytes: int | None = None,
    top_extensions: int = 20,
    largest: int = 20,
) -> DataFrame:
    """One row with the totals and breakdowns of a completed scan, else no row.

    Used bytes are capacity less free space, or the files' bytes where the
    capacity is not known. The inventory is read twice, for its sums and for its
    largest files; ``folders`` is a stored rollup.
    """
    # One pass over the files gives totals, categories and extensions.
    cube = category_extension_cube(of_scan(files, scan_id))
    sums = cube.groupingSets([["scan_id", "category"], ["scan_id", "extension"]], "scan_id", "category", "extension").agg(
        F.sum("total_bytes").alias("b"), F.sum("file_count").alias("n"),
        F.grouping("extension").alias("_by_category"))
    by_category = F.col("_by_category") == 1
    place = F.row_number().over(W.partitionBy("scan_id", "_by_category", F.col("extension").isNull()).orderBy(
        F.col("b").desc(), "extension"))
    listed = ~by_category & F.col("extension").isNotNull() & (F.col("_place") <= top_extensions)
    entry = F.struct("_place", "extension", F.col("b").alias("total_bytes"), F.col("n").alias("file_count"))
    totals = sums.withColumn("_place", place).groupBy("scan_id").agg(
        F.sum(F.when(by_category, F.col("n"))).alias("file_count"),
        F.sum(F.when(by_category, F.col("b"))).alias("_bytes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(by_category, F.struct("category", "b")))))
        .alias("category_breakdown"),
        F.transform(
            F.array_sort(F.collect_list(F.when(listed, entry))),
            lambda e: F.struct(*[e[c].alias(c) for c in ("extension", "total_bytes", "file_count")]),
        ).alias("extension_breakdown"),
    )
    dirs = of_scan(folders, scan_id).groupBy("scan_id").agg(F.count(F.lit(1)).alias("dir_count"))
    biggest_files = _largest(of_scan(files, scan_id), "size_bytes", "largest_files", largest)
    biggest_folders = _largest(
        of_scan(folders, scan_id), "total_size_bytes", "largest_folders", largest
    )
    done = of_scan(scans, scan_id).where(F.col("status").startswith("completed")).select("scan_id")
    used = F.lit(None if capacity_bytes is None or free_bytes is None
                 else capacity_bytes - free_bytes).cast("bigint")
    row = merge_by_scan([totals, dirs, biggest_files, biggest_folders], {})
    return row.join(done.distinct(), "scan_id", "left_semi").where("file_count IS NOT NULL").select(
        "scan_id",
        F.lit(snapshot_date).cast("date").alias("snapshot_date"),
        F.coalesce(F.lit(capacity_bytes).cast("bigint"), F.col("_bytes")).alias("total_size_bytes"),
        F.coalesce(used, F.col("_bytes")).alias("used_size_bytes"),
        "file_count",
        F.coalesce("dir_count", F.lit(0)).alias("dir_count"),
        "category_breakdown",
        "extension_breakdown",
        "largest_files",
        "largest_folders",
    )


def _largest(rows: DataFrame, size: str, name: str, limit: int) -> DataFrame:
    """The largest rows of one scan as a short list."""
    return (
        rows.select("scan_id", "path", F.col(size).alias("s"))
        .orderBy(F.col("s").desc(), "path")
        .limit(limit)
        .groupBy("scan_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "path"))),
                lambda e: F.struct(e["path"].alias("path"), (-e["o"]).alias("size_bytes")),
            ).alias(name)
        )
    )


def upsert_snapshots(
    stored: DataFrame, arrived: DataFrame, key: tuple[str, ...] = ("volume_id", "snapshot_date")
) -> DataFrame:
    """One snapshot per key; the one created last replaces the others.

    Of several created at one time the one with the largest JSON text counts, so
    the choice doesn't depend on the order of rows. An aggregate rather than
    numbered rows, so it reduces before the shuffle.
    """
    both = stored.unionByName(arrived)
    rest = [c for c in both.columns if c not in (*key, "created_at")]
    last = F.max_by(F.struct(*rest), F.struct("created_at", F.to_json(F.struct(*rest))))
    return both.groupBy(*key).agg(last.alias("_row"), F.max("created_at").alias("created_at")).select(
        *key, "_row.*", "created_at"
    )


def _order_of(snapshots: DataFrame, *first: str) -> Column:
    """A total order: by the columns, the scan if there is one, and the row's text."""
    scan = [c for c in ("scan_id",) if c in snapshots.columns]
    return F.struct(*first, *scan, F.to_json(F.struct(*snapshots.columns)))


def one_per_day(snapshots: DataFrame) -> DataFrame:
    """One snapshot per volume and date: that of the last scan by id."""
    keys = ["volume_id", "snapshot_date"]
    rest = [c for c in snapshots.columns if c not in keys]
    last = F.max_by(F.struct(*rest), _order_of(snapshots)).alias("_row")
    return snapshots.groupBy(*keys).agg(last).select(*keys, "_row.*")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each volume; of several scans of that date the last one by id."""
    rest = [c for c in snapshots.columns if c != "volume_id"]
    last = F.max_by(F.struct(*rest), _order_of(snapshots, "snapshot_date")).alias("_row")
    return snapshots.groupBy("volume_id").agg(last).select("volume_id", "_row.*")


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest stored snapshot of all, which reports show where none is named."""
    newest = snapshots.orderBy(F.col("snapshot_date").desc(), F.col("scan_id").desc())
    return newest.limit(1)


def snapshot_history(
    snapshots: DataFrame,
    from_date: str | None = None,
    to_date: str | None = None,
    per_volume: int | None = None,
) -> DataFrame:
    """Snapshots within the dates (inclusive), newest first; the last few of each volume if asked."""
    rows = snapshots
    if from_date is not None:
        rows = rows.where(F.col("snapshot_date") >= F.lit(from_date).cast("date"))
    if to_date is not None:
        rows = rows.where(F.col("snapshot_date") <= F.lit(to_date).cast("date"))
    if per_volume is not None:
        newest = W.partitionBy("volume_id").orderBy(F.col("snapshot_date").desc())
        rows = rows.withColumn("_rank", F.row_number().over(newest)).where(
            F.col("_rank") <= per_volume).drop("_rank")
    return rows.orderBy(F.col("snapshot_date").desc(), "volume_id")


def growth_series(snapshots: DataFrame, points: int = 30) -> DataFrame:
    """The last ``points`` snapshots of each volume.

    A volume has one row per date, so its window is bounded by the calendar;
    the rank limit also drops older rows before the shuffle.
    """
    newest = W.partitionBy("volume_id").orderBy(F.col("snapshot_date").desc())
    return (
        snapshots.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= points)
        .select("volume_id", "snapshot_date", "total_size_bytes", "used_size_bytes", "file_count")
    )


def growth_rate(series: DataFrame, value: str = "used_size_bytes") -> DataFrame:
    """Bytes per day between the first and the last snapshot of each volume."""
    ends = series.groupBy("volume_id").agg(
        F.min_by(value, "snapshot_date").alias("first_bytes"),
        F.max_by(value, "snapshot_date").alias("last_bytes"),
        F.datediff(F.max("snapshot_date"), F.min("snapshot_date")).alias("days"),
    )
    rate = F.when(
        F.col("days") > 0, (F.col("last_bytes") - F.col("first_bytes")) / F.col("days")
    ).otherwise(0.0)
    return ends.withColumn("daily_growth_bytes", rate)


#: The changes and their days.
CHANGES = {"daily": 1, "weekly": 7, "monthly": 30}


def usage_changes(snapshots: DataFrame, value: str = "used_size_bytes") -> DataFrame:
    """Daily usage with its change over a day, a week and a month of the calendar.

    The base of a change over n days is the newest snapshot at least n and less
    than 2 n days back; where a gap leaves none, the change is NULL. The base's
    date stands beside it.
    """
    days = one_per_day(snapshots).withColumn("_day", F.datediff("snapshot_date", F.lit("1970-01-01").cast("date")))
    by_day = W.partitionBy("volume_id").orderBy("_day")
    columns = []
    for name, n in CHANGES.items():
        back = by_day.rangeBetween(1 - 2 * n, -n)
        columns += [
            (F.col(value) - F.last(value).over(back)).alias(f"{name}_growth_bytes"),
            F.last("snapshot_date").over(back).alias(f"{name}_base_date"),
        ]
    return days.select("volume_id", "snapshot_date", F.col(value).alias("used_size_bytes"), *columns)


def period_usage(snapshots: DataFrame, period: str, value: str = "used_size_bytes") -> DataFrame:
    """Usage at the end of each week or month, and its growth within it."""
    return (
        snapshots.groupBy(
            "volume_id", F.to_date(F.date_trunc(period, "snapshot_date")).alias("period_start")
        )
        .agg(
            F.max_by(value, "snapshot_date").alias("end_bytes"),
            (F.max_by(value, "snapshot_date") - F.min_by(value, "snapshot_date"))
            .alias("growth_bytes"),
        )
    )


def categories_of_snapshot(snap: DataFrame) -> DataFrame:
    return snap.select(
        "scan_id", "snapshot_date", F.explode("category_breakdown").alias("category", "total_bytes")
    )


def extensions_of_snapshot(snap: DataFrame) -> DataFrame:
    return snap.select("scan_id", "snapshot_date", F.inline("extension_breakdown"))


