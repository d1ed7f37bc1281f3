"""Inventory, content, scan and event tables derived from the given parquet tables.

Each derivation is one projection (or one aggregation) over a whole table, so
its work grows with the table. The plain-SQL twins that the SQL check uses are
in ``stowage.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from stowage.functions.modes import octal_permissions
from stowage.functions.paths import category_of, with_path_parts
from stowage.session import use_utc

AS_OF = "1998-06-01 00:00:00"
SNAPSHOT_AS_OF = "2024-01-31"
SCAN_ID = "scan-1"
SECOND_SCAN_ID = "scan-2"

_FOLDERS = [
    "/src", "/node_modules/pkg", "/.venv/lib", "/target/debug", "/docs", "/__pycache__",
    "/.idea", "/checkpoints", "/data", "/build", "/dist", "/.cache/huggingface/m",
]
_SUFFIXES = [".py", ".js", ".pdf", ".jpg", ".mp4", ".zip", ".parquet", ".pt", ".log", ""]

FILE_ID_SQL = "concat(l_orderkey,'-',l_partkey,'-',l_suppkey,'-',l_linenumber)"


def _choice(selector: str, values: list[str]) -> str:
    names = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({names}), CAST({selector} AS INT) + 1)"


PATH_SQL = (
    "concat('/vol', l_suppkey % 4, '/u', l_orderkey % 50, '/proj', l_orderkey % 97, "
    + _choice("(l_partkey + l_linenumber) % 12", _FOLDERS)
    + f", '/f', {FILE_ID_SQL}, "
    + _choice("l_partkey % 10", _SUFFIXES)
    + ")"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file of the first scan, with what a listing knows of it."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"'{SCAN_ID}' AS scan_id",
        f"{FILE_ID_SQL} AS file_id",
        f"{PATH_SQL} AS path",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes",
        "CAST(l_shipdate AS TIMESTAMP) AS created_at",
        "CAST(l_shipdate AS TIMESTAMP) AS modified_at",
        "timestampadd(DAY, CAST(l_quantity AS INT), CAST(l_shipdate AS TIMESTAMP)) AS accessed_at",
        "l_orderkey % 50 + 1000 AS uid",
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('u', l_orderkey % 50) END AS owner",
        "33024 + l_linenumber * 12 AS mode",
        "l_returnflag AS flag",
        "l_linestatus AS state",
        "l_suppkey AS device",
        "concat(l_orderkey, '-', l_linenumber) AS inode",
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scan in the layout of ``schemas.INVENTORY``."""
    return with_path_parts(raw_listing(spark, sf_dir)).select(
        "scan_id", "file_id", "path", "directory", "filename", "extension", "size_bytes",
        "category", "created_at", "modified_at", "accessed_at", "owner",
        octal_permissions(F.col("mode")).alias("permissions"),
    )


def second_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next scan: returned items are gone, open ones changed, accepted ones moved."""
    raw = raw_listing(spark, sf_dir).where("flag <> 'R'")
    moved = F.when(F.col("flag") == "A", F.concat(F.col("path"), F.lit(".bak"))).otherwise(
        F.col("path")
    )
    changed = F.col("state") == "O"
    raw = (
        raw.withColumn("scan_id", F.lit(SECOND_SCAN_ID))
        .withColumn("path", moved)
        .withColumn("size_bytes", F.col("size_bytes") + F.when(changed, 1).otherwise(0))
        .withColumn(
            "modified_at",
            F.when(changed, F.expr("timestampadd(DAY, 1, modified_at)")).otherwise(
                F.col("modified_at")
            ),
        )
    )
    return with_path_parts(raw).select(
        "scan_id", "file_id", "path", "directory", "filename", "extension", "size_bytes",
        "category", "modified_at", "accessed_at",
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with their bytes."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"'{SCAN_ID}' AS scan_id",
        "CAST(doc_id AS STRING) AS file_id",
        "concat('/corpus/', source, '/', lang, '/d', doc_id, '.txt') AS path",
        "'.txt' AS extension",
        "CAST(octet_length(text) AS BIGINT) AS size_bytes",
        "encode(text, 'utf-8') AS content",
        "timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP '2024-01-01 00:00:00') AS modified_at",
    )


def second_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next scan of the documents: French ones are gone, German ones were touched."""
    kept = content(spark, sf_dir).where("path not like '%/fr/%' or path is null")
    later = F.expr("timestampadd(HOUR, 1, modified_at)")
    return kept.withColumn("scan_id", F.lit(SECOND_SCAN_ID)).withColumn(
        "modified_at", F.when(F.col("path").contains("/de/"), later).otherwise(F.col("modified_at")))


def two_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scans of the documents, whose files have the same names."""
    return content(spark, sf_dir).unionByName(second_content(spark, sf_dir))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan register: one scan per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('scan-', o_orderkey) AS scan_id",
        "concat('/vol', o_custkey % 20) AS root_path",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' "
        "ELSE 'failed' END AS status",
        "'full' AS scan_type",
        "CAST(o_orderdate AS TIMESTAMP) AS started_at",
        "CASE WHEN o_orderstatus = 'F' THEN timestampadd(SECOND, "
        "CAST(o_custkey % 3600 + 1 AS INT), CAST(o_orderdate AS TIMESTAMP)) END AS completed_at",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS total_size_bytes",
        "CAST(o_custkey % 3 AS BIGINT) AS error_count",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_events_of(table(spark, sf_dir, "events"))


def task_events_of(events: DataFrame) -> DataFrame:
    """Progress events: users are tasks, an error fails and a purchase completes."""
    return events.selectExpr(
        "CAST(user_id AS STRING) AS task_id",
        "event_id",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' "
        "ELSE 'progress' END AS event_type",
        "CAST(ts AS TIMESTAMP) AS ts",
        "value AS files_per_second",
    )


def action_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of cleanup actions: one action per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS action_id",
        "event_id",
        "CASE event_type WHEN 'view' THEN 'proposed' WHEN 'click' THEN 'dry_run_complete' "
        "WHEN 'signup' THEN 'approved' WHEN 'purchase' THEN 'executing' "
        "ELSE 'completed' END AS status",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


def action_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-target results of executed actions: an error is a target that stayed."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 40 AS STRING) AS action_id",
        "concat('/t/', event_id) AS path",
        "CAST(round(value * 100) AS BIGINT) AS size_bytes",
        "event_type <> 'error' AND user_id % 40 <> 7 AS succeeded",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations to record: one per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('audit-', event_id) AS log_id",
        "concat('corr-', user_id % 50) AS correlation_id",
        "concat('cleanup_', event_type) AS action",
        "'cleanup_action' AS entity_type",
        "CAST(user_id AS STRING) AS entity_id",
        "CAST(round(value * 100) AS BIGINT) AS bytes_affected",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' "
        "ELSE 'info' END AS severity",
        "CAST(ts AS TIMESTAMP) AS created_at",
    )


def daily_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and events per volume and date."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "CAST(user_id % 20 AS STRING) AS volume_id",
            "to_date(ts) AS snapshot_date",
            "CAST(round(value * 100) AS BIGINT) * 10000 AS bytes",
        )
        .groupBy("volume_id", "snapshot_date")
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots per volume, all days of all of them.

    Volumes 0-14 grow steadily; 15-19 show the bytes of the day itself, which
    follow no line.
    """
    by_date = W.partitionBy("volume_id").orderBy("snapshot_date")
    volume = F.col("volume_id").cast("int")
    noisy = volume >= 15
    so_far = by_date.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        daily_bytes(spark, sf_dir)
        .withColumn("running", F.sum("bytes").over(so_far))
        .withColumn("file_count", F.sum("files").over(so_far))
        .select(
            "volume_id",
            "snapshot_date",
            F.lit(10**15).cast("bigint").alias("total_size_bytes"),
            F.when(noisy, F.col("bytes")).otherwise(F.col("running")).alias("used_size_bytes"),
            "file_count",
            F.lit(0).cast("bigint").alias("dir_count"),
        )
    )


def scanned_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots with gaps of two weeks in some volumes, and two scans on some dates."""
    rows = snapshots(spark, sf_dir).where("volume_id % 3 <> 1 or dayofmonth(snapshot_date) not between 6 and 19")
    again = rows.where("dayofmonth(snapshot_date) % 4 = 2").withColumn(
        "used_size_bytes", F.col("used_size_bytes") - 1000)
    return rows.withColumn("scan_id", F.lit(SECOND_SCAN_ID)).unionByName(
        again.withColumn("scan_id", F.lit(SCAN_ID)))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as file paths, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?:/", "")
    pages = table(spark, sf_dir, "pages").select(
        F.lit(SCAN_ID).alias("scan_id"),
        F.col("page_id").cast("string").alias("file_id"),
        path.alias("path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
    )
    return with_path_parts(pages)


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their bytes, with extension and category."""
    return content(spark, sf_dir).drop("content").withColumn("category", category_of("extension"))
