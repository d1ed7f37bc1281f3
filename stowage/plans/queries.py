"""Every operator as a named query over the given tables.

Each function takes (spark, sf_dir) and returns a DataFrame over whole tables.
Times and dates are returned as text, so that results compare byte for byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.fixed_values import MIN_DUPLICATE_BYTES, SEEDED_NAME_RULES
from stowage.functions.hashing import content_hash
from stowage.functions.modes import octal_permissions, owner_or_uid
from stowage.functions.paths import directory_of, normalize_path
from stowage.functions.scoring import priority_of, trend_of
from stowage.functions.texts import human_bytes
from stowage.functions.times import days_since, epoch_to_timestamp, iso_text, parse_iso
from stowage.operators import (
    audit, breakdowns, cleanup, duplicates, exclusions, folders, forecasting, overview, paging,
    progress, recommendations, scans, snapshots, staleness, workspaces,
)
from stowage.plans import analysis_job
from stowage.session import shared_folder, use_utc
from stowage.sources import buckets, rollups, tables
from stowage.sources import given_tables as given
from stowage.streaming import jobs as streams
from stowage.streaming import tasks as task_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = given.AS_OF
SCAN = given.SCAN_ID
CAPACITY = 500_000_000_000
CHECK_RULES = [
    *[(name, "name") for name in SEEDED_NAME_RULES],
    ("LOG", "extension"),
    ("/vol3/u1", "path"),
    ("proj9/dist", "path"),
    (r"/proj1[0-9]$", "regex"),
    (r"/f1[0-9]*-[0-9-]*\.pdf$", "regex"),
    ("[", "regex"),
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def named(name: str) -> Callable[[Query], Query]:
    """Registers under a name that a module or function used here has already."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def ts_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def day_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return staleness.score_files(given.inventory(spark, sf), AS_OF)


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.full_hashes(given.content(spark, sf), MIN_DUPLICATE_BYTES)


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_groups(_hashed(spark, sf))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_members(_hashed(spark, sf))


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return workspaces.artifact_files(given.inventory(spark, sf))


def _spaces(spark: SparkSession, sf: str) -> DataFrame:
    return workspaces.with_activity(workspaces.workspaces(_artifacts(spark, sf)), AS_OF)


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return folders.folder_rollup(given.inventory(spark, sf))


# Inventory


@query
def inventory_table(spark, sf):
    files = given.inventory(spark, sf).where(F.col("scan_id") == SCAN)
    return files.select(
        "scan_id", "file_id", "path", "size_bytes",
        ts_text("modified_at").alias("modified_at"), ts_text("accessed_at").alias("accessed_at"),
    )


@query
def path_normalize(spark, sf):
    path = F.concat_ws("\\", "source", "lang", "text")
    return given.table(spark, sf, "documents").select(
        "doc_id", F.sha2(normalize_path(path), 256).alias("normalized_sha256")
    )


@query
def path_parts(spark, sf):
    columns = ["file_id", "path", "directory", "filename", "extension"]
    return given.page_paths(spark, sf).select(*columns).unionByName(
        given.inventory(spark, sf).select(*columns)
    )


@query
def category_of(spark, sf):
    columns = ["file_id", "extension", "category"]
    return given.page_paths(spark, sf).select(*columns).unionByName(
        given.inventory(spark, sf).select(*columns)
    )


@query
def file_times(spark, sf):
    seconds = F.when(F.col("flag") == "R", F.lit(0)).otherwise(F.unix_seconds("modified_at"))
    return given.raw_listing(spark, sf).select(
        "file_id", iso_text(epoch_to_timestamp(seconds)).alias("modified_text")
    )


@query
def mode_octal(spark, sf):
    return given.raw_listing(spark, sf).select(
        "file_id",
        octal_permissions(F.col("mode")).alias("permissions"),
        owner_or_uid(F.col("owner"), F.col("uid")).alias("owner"),
    )


@query
def exclude_files(spark, sf):
    files = given.inventory(spark, sf)
    rules = exclusions.rule_table(spark, CHECK_RULES)
    return exclusions.exclude_files(files, rules, substring=True).select("file_id", "path")


@query
def exclude_subtrees(spark, sf):
    files = given.inventory(spark, sf)
    rules = exclusions.rule_table(spark, CHECK_RULES)
    return exclusions.exclude_subtrees(files, rules).select("file_id", "path")


def _pattern_rules(spark, sf):
    """A pattern per supplier, most with a plain text that matches need, and one without."""
    pattern = F.expr(r"""CASE s_nationkey % 3
        WHEN 0 THEN concat('/u', s_suppkey % 50, '/proj[0-9]+/(src|docs)/f[0-9]+-[0-9]+-', s_suppkey, '-')
        WHEN 1 THEN concat('/vol', s_suppkey % 4, '/u[0-9]/proj', s_suppkey % 97, '/(build|dist)')
        ELSE concat('-', s_suppkey, '-[1-3]\\.(mp4|zip)$|/proj', s_suppkey % 97, '/\\.cache/hugging') END""")
    stored = given.table(spark, sf, "supplier").select(
        pattern.alias("pattern"), F.lit("regex").alias("rule_type"), F.lit(True).alias("is_active"))
    return stored.unionByName(exclusions.rule_table(spark, [(r"[1-3]-[0-9]\.p[a-y]$", "regex")]))


@query
def exclude_files_patterns(spark, sf):
    kept = exclusions.exclude_files(given.inventory(spark, sf), _pattern_rules(spark, sf))
    return kept.select("file_id", "path")


@query
def exclude_subtrees_patterns(spark, sf):
    kept = exclusions.exclude_subtrees(given.inventory(spark, sf), _pattern_rules(spark, sf))
    return kept.select("file_id", "path")


def _stored_rules(spark, sf):
    return given.table(spark, sf, "supplier").select(
        F.col("s_name").alias("pattern"),
        F.when(F.col("s_nationkey") < 5, "extension").otherwise("name").alias("rule_type"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )


@query
def rule_sources(spark, sf):
    return exclusions.rule_sources(spark, _stored_rules(spark, sf), ["tmp", "scratch"]).select(
        "pattern", "rule_type"
    )


@query
def folder_table(spark, sf):
    return folders.folder_table(given.inventory(spark, sf))


@query
def folder_rollup(spark, sf):
    return _rollup(spark, sf)


@query
def folder_rollup_delta(spark, sf):
    """The first scan's stored rollup, brought up to date from what changed until the second one."""
    folder = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    # Grouped by the path alone, the rows lie as the delta's join needs them.
    first, second = (
        scan(spark, sf).groupBy("path").agg(
            F.max("scan_id").alias("scan_id"), F.max("size_bytes").alias("size_bytes"),
            F.max("modified_at").alias("modified_at")).withColumn("directory", directory_of(F.col("path")))
        for scan in (given.inventory, given.second_inventory))
    rollups.write_rollup(folders.folder_rollup(first), folder)
    rollups.update_rollup(spark, folder, scans.inventory_delta(first, second))
    return folders.with_folder_columns(rollups.read_rollup(spark, folder))


@query
def folder_direct_sizes(spark, sf):
    return folders.direct_sizes(given.page_paths(spark, sf))


@query
def depth_limit(spark, sf):
    files = given.inventory(spark, sf)
    return folders.depth_limit(files, 4).select("file_id", "path")


@query
def scan_totals(spark, sf):
    files = given.inventory(spark, sf)
    register = given.scans(spark, sf)
    # Files of all volumes belong to the one scan; the register has its times.
    return scans.scan_totals(files, folders.folder_table(files), register)


@query
def scan_registry(spark, sf):
    register = given.scans(spark, sf)
    listed = scans.list_scans(register, "completed")
    return paging.page(listed, scans.scan_order(), 2, 50).select(
        "scan_id", "root_path", "status", ts_text("created_at").alias("created_at"),
        "total_size_bytes",
    )


@query
def scan_latest_completed(spark, sf):
    return scans.latest_completed(given.scans(spark, sf), per_root=True).select(
        "root_path", "scan_id", ts_text("completed_at").alias("completed_at"), "total_size_bytes"
    )


@query
def inventory_sink(spark, sf):
    """Writes the inventory twice and reads it back: the second write replaces."""
    folder = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    files = given.inventory(spark, sf)
    tables.write_inventory(files, folder)
    tables.write_inventory(files, folder)
    stored = tables.read_inventory(spark, folder, SCAN)
    return stored.groupBy("scan_id", "category").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes")
    )


@query
def inventory_arrivals(spark, sf):
    """A listing of the scan and two batches of changes in one store; one batch comes twice."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    files = given.inventory(spark, sf).select("scan_id", "path", "size_bytes", "category")
    tables.write_inventory(files, folder)
    grown = files.where("category = 'code'").withColumn("size_bytes", F.col("size_bytes") + 1)
    moved = files.where("category = 'image'").withColumn("path", F.concat("path", F.lit(".new")))
    for number, batch in ((0, grown), (1, moved), (1, moved)):
        tables.add_arrivals(batch, folder, number)
    return tables.current_inventory(spark, folder, SCAN).groupBy("category", "batch").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"))


@query
def inventory_delta(spark, sf):
    delta = scans.inventory_delta(given.inventory(spark, sf), given.second_inventory(spark, sf))
    return delta.select("path", "change", "old_size_bytes", "size_bytes")


@query
def inventory_delta_summary(spark, sf):
    return scans.delta_summary(
        scans.inventory_delta(given.inventory(spark, sf), given.second_inventory(spark, sf))
    )


# Analytics


@query
def total_stats(spark, sf):
    return breakdowns.total_stats(given.inventory(spark, sf), SCAN)


@query
def category_breakdown(spark, sf):
    return breakdowns.category_breakdown(given.inventory(spark, sf), SCAN)


@query
def extension_breakdown(spark, sf):
    return breakdowns.extension_breakdown(given.inventory(spark, sf), SCAN)


@query
def largest_files(spark, sf):
    return breakdowns.largest_files(given.inventory(spark, sf), SCAN).withColumn(
        "modified_at", ts_text("modified_at")
    )


@query
def largest_folders(spark, sf):
    return breakdowns.largest_folders(_rollup(spark, sf), SCAN)


@query
def folder_count(spark, sf):
    return breakdowns.folder_count(folders.folder_table(given.inventory(spark, sf)), SCAN)


def _snapshot(spark, sf):
    files = given.inventory(spark, sf)
    done = spark.range(1).select(F.lit(SCAN).alias("scan_id"), F.lit("completed").alias("status"))
    folder = f"{shared_folder(spark)}/folders-{uuid.uuid4().hex}"
    rollup = _rollup(spark, sf)
    tables.replace_partitions(rollup, folder, "scan_id")
    return snapshots.snapshot(
        files, tables.read_table(rollup, folder), done, SCAN, "1998-06-01", CAPACITY, CAPACITY // 4
    )


@query
def snapshot(spark, sf):
    def joined(entries, *names):
        return F.array_join(
            F.transform(entries, lambda e: F.concat_ws(":", *[e[n].cast("string") for n in names])),
            ",",
        )

    return _snapshot(spark, sf).select(
        "scan_id", day_text("snapshot_date").alias("snapshot_date"), "total_size_bytes",
        "used_size_bytes", "file_count", "dir_count",
        joined(F.map_entries("category_breakdown"), "key", "value").alias("categories"),
        joined(F.col("extension_breakdown"), "extension", "total_bytes", "file_count")
        .alias("extensions"),
        joined(F.col("largest_files"), "path", "size_bytes").alias("largest_files"),
        joined(F.col("largest_folders"), "path", "size_bytes").alias("largest_folders"),
    )


@query
def snapshot_upsert(spark, sf):
    """Morning and evening totals of each day: the evening one stays."""
    events = given.table(spark, sf, "events").select(
        F.col("event_id"),
        F.to_timestamp(F.col("ts")).alias("created_at"),
        F.to_date("ts").alias("snapshot_date"),
        F.lit("volume-1").alias("volume_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("used_size_bytes"),
    )
    early = events.where(F.hour("created_at") < 12)
    late = events.where(F.hour("created_at") >= 12)
    return snapshots.upsert_snapshots(early, late).select(
        "volume_id", day_text("snapshot_date").alias("snapshot_date"), "used_size_bytes",
        "event_id", ts_text("created_at").alias("created_at"),
    )


def _overview(spark, sf):
    files = given.inventory(spark, sf)
    return overview.overview(
        _scored(spark, sf), folders.folder_table(files), _groups(spark, sf), _spaces(spark, sf),
        SCAN, CAPACITY, "1998-06-01T00:00:00.000000Z",
    )


@query
def storage_health(spark, sf):
    return overview.storage_health(_overview(spark, sf))


@query
def categories_report(spark, sf):
    return snapshots.categories_of_snapshot(_snapshot(spark, sf)).withColumn(
        "snapshot_date", day_text("snapshot_date")
    )


@query
def extensions_report(spark, sf):
    return snapshots.extensions_of_snapshot(_snapshot(spark, sf)).withColumn(
        "snapshot_date", day_text("snapshot_date")
    )


@query
def largest_files_report(spark, sf):
    files = given.inventory(spark, sf)
    return breakdowns.with_total_count(
        breakdowns.largest_files(files, SCAN, 20).select("file_id", "path", "size_bytes"), files
    )


@query
def largest_folders_report(spark, sf):
    rollup = _rollup(spark, sf)
    return breakdowns.with_total_count(breakdowns.largest_folders(rollup, SCAN, 20), rollup)


@query
def latest_snapshot(spark, sf):
    return snapshots.latest_snapshot(given.scanned_snapshots(spark, sf)).withColumn(
        "snapshot_date", day_text("snapshot_date")
    )


@query
def snapshot_history(spark, sf):
    rows = snapshots.snapshot_history(
        given.snapshots(spark, sf), "2024-01-05", "2024-01-20"
    )
    return rows.withColumn("snapshot_date", day_text("snapshot_date"))


@query
def growth_series(spark, sf):
    return snapshots.growth_series(given.snapshots(spark, sf), 14).withColumn(
        "snapshot_date", day_text("snapshot_date")
    )


@query
def growth_rate(spark, sf):
    return snapshots.growth_rate(given.snapshots(spark, sf)).withColumn(
        "daily_growth_bytes", F.round("daily_growth_bytes", 2)
    )


@query
def weekly_monthly_usage(spark, sf):
    rows = snapshots.usage_changes(given.scanned_snapshots(spark, sf))
    return rows.withColumns({c: day_text(c) for c in rows.columns if c.endswith("_date")})


@query
def weekly_usage(spark, sf):
    return snapshots.period_usage(given.snapshots(spark, sf), "week").withColumn(
        "period_start", day_text("period_start")
    )


@query
def paged_list(spark, sf):
    files = paging.where_all(
        given.inventory(spark, sf), [F.col("category") == "code", F.col("size_bytes") >= 1_000_000]
    )
    order = [F.col("size_bytes").desc(), F.col("path"), F.col("file_id")]
    return paging.page(files, order, 3, 40).select("file_id", "path", "size_bytes")


@query
def paged_list_deep(spark, sf):
    """A page far behind, from a stored ranking of all files."""
    folder = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    files = given.inventory(spark, sf).select("file_id", "path", "size_bytes")
    order = [F.col("size_bytes").desc(), F.col("path"), F.col("file_id")]
    paging.write_ranked(files, order, folder)
    return paging.ranked_page(spark, folder, files.schema, 117, 50)


@query
def paged_list_after(spark, sf):
    """The page behind a known row."""
    files = given.inventory(spark, sf).select("file_id", "path", "size_bytes")
    order = [("size_bytes", True), ("path", False), ("file_id", False)]
    return paging.page_behind(files, order, (3_000_000, "/vol2", ""), 40)


@query
def paged_list_totals(spark, sf):
    files = given.inventory(spark, sf).where("category = 'code' AND size_bytes >= 1000000")
    return paging.page_totals(files, 40)


@query
def share_of_total(spark, sf):
    return breakdowns.with_share(breakdowns.category_breakdown(given.inventory(spark, sf), SCAN))


# Duplicates


@query
def dup_size_groups(spark, sf):
    return duplicates.size_groups(given.two_contents(spark, sf).drop("content"))


@query
def dup_size_candidates(spark, sf):
    return duplicates.same_size_files(given.two_contents(spark, sf).drop("content")).select(
        "scan_id", "file_id", "size_bytes"
    )


@query
def dup_partial_hash(spark, sf):
    return duplicates.partial_hash_candidates(given.two_contents(spark, sf)).select(
        "scan_id", "file_id", "size_bytes"
    )


@query
def dup_full_hash(spark, sf):
    return duplicates.full_hashes(given.content(spark, sf)).select(
        "file_id", "path", "size_bytes", "sha256"
    )


@query
def dup_groups(spark, sf):
    return _groups(spark, sf)


@query
def dup_members(spark, sf):
    return _members(spark, sf).select("group_id", "file_id", "path", "is_keeper")


@query
def dup_flag(spark, sf):
    return duplicates.duplicate_flags(_hashed(spark, sf)).select(
        "file_id", "path", F.col("is_duplicate").cast("int").alias("is_duplicate")
    )


@query
def dup_summary(spark, sf):
    return duplicates.duplicate_summary(_groups(spark, sf))


@query
def dup_top_extensions(spark, sf):
    return duplicates.top_duplicate_extensions(_members(spark, sf))


@query
def dup_group_list(spark, sf):
    listed = duplicates.filter_groups(_groups(spark, sf), 2000, "unresolved")
    return paging.page(listed, duplicates.group_order(), 1, 20).select(
        "group_id", "file_size_bytes", "member_count", "wasted_bytes", "status"
    )


@query
def dup_group_list_totals(spark, sf):
    return paging.page_totals(
        duplicates.filter_groups(_groups(spark, sf), 2000, "unresolved"), 20
    )


@query
def dup_group_detail(spark, sf):
    return duplicates.group_detail(_members(spark, sf)).drop("scan_id").withColumn(
        "is_keeper", F.col("is_keeper").cast("int")
    )


def _decisions(spark, sf):
    """Labelled documents were looked at: good ones are to be kept."""
    hashed = _hashed(spark, sf).select("scan_id", "file_id", F.col("sha256").alias("group_id"))
    good = given.table(spark, sf, "labels").where("quality = 1").select(
        F.col("doc_id").cast("string").alias("file_id"), F.col("doc_id").alias("decided_at")
    )
    return hashed.join(good, "file_id").select(
        "scan_id", "group_id", F.col("file_id").alias("keep_file_id"), "decided_at"
    )


def _resolved(spark, sf):
    return duplicates.resolved_members(_hashed(spark, sf), _decisions(spark, sf))


@query
def dup_resolve(spark, sf):
    return _resolved(spark, sf).select(
        "group_id", "file_id", "status", F.col("is_keeper").cast("int").alias("is_keeper")
    )


@query
def dup_resolve_report(spark, sf):
    return duplicates.resolve_report(_resolved(spark, sf)).drop("scan_id")


@query
def dup_auto_keeper(spark, sf):
    keepers = duplicates.auto_keepers(_members(spark, sf), "newest")
    return keepers.select("group_id", "keep_file_id")


def _removable(spark, sf, spare_first_too=False):
    return duplicates.removable_files(
        _hashed(spark, sf), _decisions(spark, sf), spare_first_too
    )


@query
def dup_removable(spark, sf):
    return _removable(spark, sf).select("group_id", "file_id", "path", "size_bytes")


@query
def dup_removable_strict(spark, sf):
    return _removable(spark, sf, True).select("group_id", "file_id", "path", "size_bytes")


@query
def dup_removable_bytes(spark, sf):
    return duplicates.removable_totals(_removable(spark, sf))


@query
def dup_verify_bytes(spark, sf):
    checked = duplicates.verify_bytes(given.content(spark, sf), _hashed(spark, sf))
    return checked.drop("scan_id").withColumn("identical", F.col("identical").cast("int"))


@named("content_hash")
def content_hash_of(spark, sf):
    return given.content(spark, sf).select(
        "file_id", content_hash(F.col("content")).alias("sha256")
    )


@query
def dup_replace(spark, sf):
    """Stores the groups twice: the second run replaces the first."""
    folder = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    for _ in range(2):
        tables.replace_partitions(_groups(spark, sf), folder, "scan_id")
    return duplicates.duplicate_summary(spark.read.parquet(folder))


@query
def dup_incremental(spark, sf):
    """A second scan in which German files were touched: only they are hashed again.

    Digests of the first scan and content of the second lie in like buckets.
    """
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = duplicates.full_hashes(given.content(spark, sf))
    known = buckets.write_buckets(known, f"{folder}/known", duplicates.STATE, count)
    found = buckets.write_buckets(given.second_content(spark, sf), f"{folder}/found", duplicates.STATE, count)
    hashed = duplicates.incremental_hashes(found, known)
    return duplicates.duplicate_groups(hashed.where("size_bytes >= 1024")).select(
        "scan_id", "group_id", "file_size_bytes", "member_count", "wasted_bytes"
    )


@query
def hardlink_collapse(spark, sf):
    listed = given.raw_listing(spark, sf).select(
        "device", "inode", "path", "file_id", "size_bytes"
    )
    return duplicates.collapse_hardlinks(listed)


# Staleness


@named("days_since")
def days_since_text(spark, sf):
    """Ages from stored text: some without a zone, some that are no time."""
    stored = F.when(F.col("flag") == "R", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss"))
    stored = stored.when(F.col("state") == "O", F.lit("not-a-date")).otherwise(
        iso_text(F.col("modified_at"))
    )
    age = days_since(parse_iso(stored), AS_OF)
    return given.raw_listing(spark, sf).select("file_id", F.round(age, 4).alias("days"))


@query
def stale_score(spark, sf):
    return _scored(spark, sf).select("file_id", "stale_score")


@query
def is_stale(spark, sf):
    return _scored(spark, sf).select("file_id", F.col("is_stale").cast("int").alias("is_stale"))


@query
def freshness_by_age(spark, sf):
    return staleness.freshness_by_age(given.inventory(spark, sf), AS_OF, 60, 365, 1000)


@query
def is_dev_artifact(spark, sf):
    return _scored(spark, sf).select(
        "file_id", F.col("is_artifact").cast("int").alias("is_artifact")
    )


@query
def risk_level(spark, sf):
    return _scored(spark, sf).select("file_id", "risk_level")


@query
def stale_scan(spark, sf):
    return _scored(spark, sf).select(
        "file_id", "path", "stale_score", "tier", "risk_level",
        F.col("is_stale").cast("int").alias("is_stale"),
    )


@query
def stale_summary(spark, sf):
    return staleness.stale_summary(_scored(spark, sf), SCAN)


@query
def stale_risk_breakdown(spark, sf):
    return staleness.stale_risk_breakdown(_scored(spark, sf), SCAN)


@query
def stale_files(spark, sf):
    listed = staleness.stale_files(_scored(spark, sf), "archive_candidate", "low", "code", 100_000)
    return paging.page(listed, staleness.stale_order(), 2, 100).select(
        "file_id", "path", "stale_score", "size_bytes"
    )


@query
def dev_artifact_summary(spark, sf):
    return staleness.artifact_summary(given.inventory(spark, sf), SCAN)


@query
def dev_artifact_totals(spark, sf):
    return staleness.artifact_totals(staleness.artifact_summary(given.inventory(spark, sf), SCAN))


@query
def orphaned_content(spark, sf):
    """Files whose scan is not registered: here a scan per order, some dropped."""
    files = given.inventory(spark, sf).withColumn(
        "scan_id", F.concat(F.lit("scan-"), F.substring_index("file_id", "-", 1))
    )
    kept = given.scans(spark, sf).where("status = 'completed'")
    return staleness.orphaned_files(files, kept).select("file_id", "scan_id")


# Workspaces


@query
def artifact_match(spark, sf):
    return _artifacts(spark, sf).select(
        "file_id", "root", "workspace_type", "artifact_type", "risk_level",
        F.col("is_safe").cast("int").alias("is_safe"),
    )


@named("workspace_root")
def workspace_root_of_files(spark, sf):
    return _artifacts(spark, sf).select("file_id", "path", "root")


@query
def workspace_type(spark, sf):
    return _spaces(spark, sf).select("path", "workspace_type")


@named("workspace_risk")
def workspace_risk_of_spaces(spark, sf):
    return _spaces(spark, sf).select("path", "workspace_type", "risk_level")


@query
def ml_model_files(spark, sf):
    return workspaces.model_files(given.inventory(spark, sf)).select(
        "file_id", "root", "size_bytes"
    )


def _space_columns(spaces: DataFrame) -> DataFrame:
    return spaces.select(
        "path", "name", "workspace_type", "total_size_bytes", "recoverable_bytes",
        "safe_recoverable_bytes", "file_count", "risk_level", "days_inactive",
        F.col("is_active").cast("int").alias("is_active"),
        ts_text("last_modified_at").alias("last_modified_at"),
    )


@named("workspaces")
def workspaces_detected(spark, sf):
    return _space_columns(_spaces(spark, sf))


@query
def workspace_artifacts(spark, sf):
    return workspaces.workspace_artifacts(_artifacts(spark, sf)).drop("scan_id")


@query
def workspace_artifact_lists(spark, sf):
    text = F.array_join(
        F.transform(
            "artifacts",
            lambda a: F.concat_ws(":", a["type"], a["total_bytes"].cast("string"),
                                  a["file_count"].cast("string")),
        ),
        ",",
    )
    return _spaces(spark, sf).select("path", text.alias("artifacts"))


@query
def project_name_key(spark, sf):
    """Copies of projects named after brands and containers of parts."""
    from stowage.functions.projects import project_name_key as key

    return _named_projects(spark, sf).select(
        "project_id", "name", key(F.col("name")).alias("name_key")
    )


def _named_projects(spark, sf):
    suffixes = ["", "-copy", "-final-v2", " (2)", "_backup 3", "-2", "-old", " Ver12"]
    chain = F.element_at(
        F.array(*[F.lit(s) for s in suffixes]), (F.col("p_size") % len(suffixes) + 1).cast("int")
    )
    return given.table(spark, sf, "part").select(
        F.col("p_partkey").alias("project_id"),
        F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-b")), chain).alias("name"),
        (F.round(F.col("p_retailprice") * 100)).cast("bigint").alias("recoverable_bytes"),
    )


@query
def lookalike_projects(spark, sf):
    named = _named_projects(spark, sf).withColumn(
        "path", F.concat_ws("/", F.lit("/projects"), F.col("project_id").cast("string"), "name")
    )
    return workspaces.lookalike_projects(named).select("name_key", "path", "group_size")


@query
def abandoned_flag(spark, sf):
    return _spaces(spark, sf).select(
        "path", "days_inactive", F.col("is_active").cast("int").alias("is_active")
    )


@query
def workspace_summary(spark, sf):
    return workspaces.workspace_summary(_spaces(spark, sf))


@query
def workspace_list(spark, sf):
    listed = workspaces.filter_workspaces(_spaces(spark, sf), "node", False, 100_000)
    return paging.page(listed, workspaces.workspace_order(), 1, 100).select(
        "path", "workspace_type", "recoverable_bytes", "days_inactive"
    )


@query
def abandoned_projects(spark, sf):
    return workspaces.abandoned_projects(_spaces(spark, sf)).select(
        "path", "recoverable_bytes", "days_inactive", "abandoned_count", "abandoned_bytes"
    )


@query
def workspace_job(spark, sf):
    """Detection, activity and the bytes of the whole project in one plan."""
    full = workspaces.with_project_bytes(_spaces(spark, sf), _rollup(spark, sf))
    return full.select(
        "path", "workspace_type", "recoverable_bytes", "days_inactive", "project_total_bytes"
    )


@query
def inactivity_buckets(spark, sf):
    return workspaces.inactivity_report(_spaces(spark, sf))


@query
def download_bloat(spark, sf):
    found = workspaces.download_bloat(given.inventory(spark, sf), AS_OF, folder="docs")
    return found.select("file_id", "path", "size_bytes")


@query
def model_hoarding(spark, sf):
    return workspaces.model_hoarding(_artifacts(spark, sf)).drop("scan_id")


@query
def recovery_split(spark, sf):
    return workspaces.recovery_split(_spaces(spark, sf))


# Forecasts


def _points(spark, sf):
    return forecasting.series_points(given.snapshots(spark, sf))


def _capacity(spark, sf):
    """Even volumes have a known capacity."""
    return (
        given.snapshots(spark, sf)
        .groupBy(F.col("volume_id").alias("series"))
        .agg((F.max("used_size_bytes") * 3).alias("capacity_bytes"))
        .where(F.col("series").cast("int") % 2 == 0)
    )


def _forecasts(spark, sf):
    return forecasting.forecasts(_points(spark, sf), given.SNAPSHOT_AS_OF, _capacity(spark, sf))


def _forecast_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "series", "model_type",
        F.round("daily_growth_bytes", 0).alias("daily_growth_bytes"),
        F.round("weekly_growth_bytes", 0).alias("weekly_growth_bytes"),
        F.round(F.col("predicted_total_30d") / 1000.0, 0).alias("predicted_kb_30d"),
        F.round(F.col("predicted_total_90d") / 1000.0, 0).alias("predicted_kb_90d"),
        day_text("exhaustion_date").alias("exhaustion_date"),
        "days_until_full",
        F.round("confidence", 3).alias("confidence"),
        "trend",
        F.round("r_squared", 6).alias("r_squared"),
        "data_points_used",
    )


@query
def forecast_series(spark, sf):
    return _points(spark, sf)


@query
def growth_deltas(spark, sf):
    rows = forecasting.growth_deltas(_points(spark, sf)).where("delta IS NOT NULL")
    return rows.select("series", "day_index", F.round("delta", 2).alias("delta"))


@query
def rolling_growth(spark, sf):
    return forecasting.rolling_growth(_points(spark, sf)).withColumn(
        "rolling_growth_bytes", F.round("rolling_growth_bytes", 0)
    )


@query
def forecast_linear(spark, sf):
    return _forecast_columns(forecasting.one_model(_forecasts(spark, sf), "linear"))


@query
def forecast_moving_average(spark, sf):
    return _forecast_columns(forecasting.one_model(_forecasts(spark, sf), "moving"))


@query
def forecast_exp_smoothing(spark, sf):
    return _forecast_columns(forecasting.one_model(_forecasts(spark, sf), "smoothing"))


@query
def forecast_auto(spark, sf):
    return _forecast_columns(forecasting.one_model(_forecasts(spark, sf), "auto"))


@query
def trend_class(spark, sf):
    """Trends of customers' growth relative to their balance."""
    return given.table(spark, sf, "customer").select(
        "c_custkey",
        trend_of(F.col("c_custkey") % 7 * F.lit(1.5), F.round(F.col("c_acctbal")).cast("bigint"))
        .alias("trend"),
    )


@query
def forecast_confidence(spark, sf):
    return _forecasts(spark, sf).select(
        "series", F.round("linear.confidence", 3).alias("confidence")
    )


@query
def exhaustion(spark, sf):
    return _forecasts(spark, sf).select(
        "series", "auto.days_until_full",
        day_text("auto.exhaustion_date").alias("exhaustion_date"),
    )


@query
def capacity_default(spark, sf):
    return _forecasts(spark, sf).select("series", "capacity_bytes")


def _stored_forecasts(spark, sf):
    """Two appended runs per series: a line fit first, the automatic choice later."""
    folder = f"{shared_folder(spark)}/forecasts-{uuid.uuid4().hex}"
    fitted = _forecasts(spark, sf)
    for model, at in (("linear", "2024-01-30 00:00:00"), ("auto", "2024-01-31 00:00:00")):
        rows = forecasting.one_model(fitted, model).withColumn(
            "created_at", F.lit(at).cast("timestamp")
        )
        tables.append(rows, folder)
    return spark.read.parquet(folder)


@query
def forecast_store(spark, sf):
    """All stored runs: appended, none replaced."""
    return _stored_forecasts(spark, sf).groupBy("series").agg(
        F.count(F.lit(1)).alias("stored_runs"),
        ts_text(F.max("created_at")).alias("last_created_at"),
    )


@query
def latest_forecast(spark, sf):
    return _forecast_columns(forecasting.latest_forecast(_stored_forecasts(spark, sf)))


def _all_series(spark, sf):
    """All customers' volumes, most of them without a forecast."""
    return given.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("series")
    )


@query
def exhaustion_report(spark, sf):
    latest = forecasting.one_model(_forecasts(spark, sf))
    report = forecasting.exhaustion_report(latest, _all_series(spark, sf))
    return report.select(
        "series", day_text("exhaustion_date").alias("exhaustion_date"), "days_until_full",
        F.round("daily_growth_bytes", 0).alias("daily_growth_bytes"),
        F.round("weekly_growth_bytes", 0).alias("weekly_growth_bytes"),
        F.round("confidence", 3).alias("confidence"), "model_type",
    )


@query
def growth_rate_report(spark, sf):
    latest = forecasting.one_model(_forecasts(spark, sf))
    report = forecasting.growth_rate_report(latest, _all_series(spark, sf))
    rounded = [f"{p}_growth_bytes" for p in ("daily", "weekly", "monthly")]
    return report.select(
        "series", *[F.round(c, 0).alias(c) for c in rounded], "trend",
        F.round("confidence", 3).alias("confidence"),
    )


# Recommendations


@named("priority_of")
def priority_of_bytes(spark, sf):
    size = "CAST(round(o_totalprice * 1000) AS BIGINT) * 500"
    risk = "if(o_orderstatus = 'F', 'low', 'medium')"
    return given.table(spark, sf, "orders").select(
        "o_orderkey", priority_of(f"({size})", risk).alias("priority")
    )


@named("human_bytes")
def human_bytes_text(spark, sf):
    size = "CAST(round(o_totalprice * 100) AS BIGINT) * o_custkey"
    return given.table(spark, sf, "orders").select(
        "o_orderkey",
        human_bytes(size).alias("size_text"),
        human_bytes(f"{size} * 1000", with_terabytes=True).alias("large_text"),
        human_bytes("o_custkey").alias("small_text"),
    )


def _context(spark, sf):
    """The scored inventory is read for its sums, its largest files and its workspaces."""
    scored = _scored(spark, sf)
    contexts = recommendations.context_of(
        [duplicates.duplicate_totals(_hashed(spark, sf))], scored, _spaces(spark, sf))
    # As much space is free as files use, and a hundredth of it is gone each day.
    return contexts.withColumns({
        "free_storage": F.col("total_bytes"), "daily_growth_bytes": F.col("total_bytes") / 100.0})


def _recs(spark, sf):
    return recommendations.recommendations(_context(spark, sf))


@named("context")
def recommendation_context(spark, sf):
    return _context(spark, sf).select(
        "scan_id", "duplicate_groups", "duplicate_files", "wasted_bytes", "stale_bytes",
        "stale_count", "archive_bytes", "archive_count", "workspace_count", "workspace_bytes",
        "workspace_safe_bytes", "inactive_workspaces", "free_storage",
        F.round("daily_growth_bytes", 0).alias("daily_growth_bytes"),
        F.array_join("top_extensions", ",").alias("top_extensions"),
        F.array_join(
            F.transform("by_type", lambda t: F.concat_ws(
                ":", t["workspace_type"], t["count"].cast("string"),
                t["recoverable_bytes"].cast("string"))), ",",
        ).alias("by_type"),
        F.array_join(
            F.transform("largest_files", lambda f: F.concat_ws(
                ":", f["path"], f["size_bytes"].cast("string"))), ",",
        ).alias("largest_files"),
    )


def _rec_columns(recs: DataFrame) -> DataFrame:
    return recs.select(
        "recommendation_id", "scan_id", "category", "priority", "title", "description",
        "explanation", "confidence", "risk_level", "recoverable_bytes", "affected_count",
        F.array_join("affected_paths", ",").alias("affected_paths"), "status",
    )


@named("recommendations")
def recommendations_made(spark, sf):
    return _rec_columns(_recs(spark, sf))


def _rule_query(category: str) -> Query:
    def run(spark, sf):
        return _rec_columns(
            recommendations.filter_recommendations(_recs(spark, sf), category=category)
        )
    return run


QUERIES["rec_growth_warning"] = _rule_query("growth_warning")
QUERIES["rec_duplicates"] = _rule_query("duplicate_cleanup")
QUERIES["rec_workspaces"] = _rule_query("workspace_cleanup")


@query
def rec_stale(spark, sf):
    recs = _recs(spark, sf).where(F.col("category").isin("archive", "stale_cleanup"))
    return _rec_columns(recs)


@query
def rec_large_files(spark, sf):
    """The inventory's sizes times 2000, so that some files exceed the limit."""
    scored = _scored(spark, sf).withColumn("size_bytes", F.col("size_bytes") * 2000)
    contexts = recommendations.context_of(
        [duplicates.duplicate_totals(_hashed(spark, sf))], scored, _spaces(spark, sf)
    )
    recs = recommendations.recommendations(contexts, [recommendations.large_file_review])
    return _rec_columns(recs)


@query
def rec_list(spark, sf):
    listed = recommendations.filter_recommendations(_recs(spark, sf), "pending", "critical")
    return paging.page(listed, recommendations.recommendation_order(), 1, 20).select(
        "recommendation_id", "priority", "recoverable_bytes"
    )


@query
def rec_detail(spark, sf):
    return _rec_columns(
        recommendations.recommendation_detail(_recs(spark, sf), f"{SCAN}/archive/archive")
    )


def _rec_decisions(spark, sf):
    """Users decide on kinds of recommendations; the newest decision counts."""
    kinds = [
        "archive/archive", "stale_cleanup/stale", "duplicate_cleanup/duplicates",
        "workspace_cleanup/regenerable",
    ]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("user_id") % 4 + 1).cast("int"))
    return given.table(spark, sf, "events").select(
        F.concat_ws("/", F.lit(SCAN), kind).alias("recommendation_id"),
        F.when(F.col("event_type") == "error", "dismissed").otherwise("accepted").alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("by user "), F.col("user_id")))
        .alias("reason"),
        F.col("event_id").alias("decided_at"),
    )


@query
def rec_decide(spark, sf):
    decided = recommendations.apply_decisions(_recs(spark, sf), _rec_decisions(spark, sf))
    return decided.select("recommendation_id", "status", "dismissed_reason")


@query
def rec_replace(spark, sf):
    """Stores the recommendations, and then the stored ones in their own place."""
    folder = f"{shared_folder(spark)}/recommendations-{uuid.uuid4().hex}"
    made = _recs(spark, sf)
    tables.replace_partitions(made, folder, "scan_id")
    tables.replace_partitions(tables.read_table(made, folder), folder, "scan_id")
    return spark.read.parquet(folder).groupBy("scan_id", "priority").agg(
        F.count(F.lit(1)).alias("recommendation_count"),
        F.sum("recoverable_bytes").alias("recoverable_bytes"),
    )


@named("analysis_job")
def analysis_of_scan(spark, sf):
    """The whole pipeline into stored tables, and how many rows each one got."""
    folder = f"{shared_folder(spark)}/analysis-{uuid.uuid4().hex}"
    done = spark.range(1).select(F.lit(SCAN).alias("scan_id"), F.lit("completed").alias("status"))
    return analysis_job.run_analysis(
        spark, given.inventory(spark, sf), _hashed(spark, sf), done, given.snapshots(spark, sf),
        folder, SCAN, AS_OF, CAPACITY, CAPACITY // 4,
    )


@query
def analysis_history(spark, sf):
    """Two scans on two dates: the second run forecasts from the snapshots that both have stored."""
    folder = f"{shared_folder(spark)}/analysis-{uuid.uuid4().hex}"
    ids = (SCAN, given.SECOND_SCAN_ID)
    done = spark.range(2).select(
        F.element_at(F.array(*[F.lit(i) for i in ids]), (F.col("id") + 1).cast("int")).alias("scan_id"),
        F.lit("completed").alias("status"))
    columns = [c for c in given.inventory(spark, sf).columns]
    second = given.second_inventory(spark, sf)
    runs = [(SCAN, given.inventory(spark, sf), AS_OF),
            (given.SECOND_SCAN_ID, second.where("path not like '%.bak'"), "1998-06-11 00:00:00")]
    for scan, files, as_of in runs:
        wide = files.withColumns({c: F.lit(None).cast("string") for c in columns if c not in files.columns})
        hashed = _hashed(spark, sf).withColumn("scan_id", F.lit(scan))
        analysis_job.run_analysis(spark, wide, hashed, done, None, folder, scan, as_of, volume_id="vol")
    grown = snapshots.growth_rate(spark.read.parquet(f"{folder}/snapshots"))
    forecasts = spark.read.parquet(f"{folder}/forecasts").withColumnRenamed("series", "volume_id")
    return forecasts.drop("daily_growth_bytes").join(grown, "volume_id").select(
        "scan_id", day_text("forecast_date").alias("forecast_date"), "volume_id",
        F.col("data_points_used").cast("bigint").alias("points"), "first_bytes", "last_bytes",
        F.round("daily_growth_bytes", 1).alias("daily_growth_bytes"))


# Cleanup and audit


def _plan(spark, sf):
    """Three actions: remove duplicates, archive old code, remove caches."""
    removable = duplicates.removable_files(_hashed(spark, sf))
    old = staleness.stale_files(_scored(spark, sf), "archive_candidate", category="code")
    caches = _artifacts(spark, sf).where("is_safe")
    return (
        cleanup.propose(removable, "act-duplicates", "trash")
        .unionByName(cleanup.propose(old, "act-archive", "archive"))
        .unionByName(cleanup.propose(caches, "act-caches", "compress"))
    )


@query
def plan_propose(spark, sf):
    return cleanup.proposal_totals(_plan(spark, sf))


@query
def plan_dry_run(spark, sf):
    """The plan against the next scan, in which some targets are gone."""
    return cleanup.dry_run(
        cleanup.dry_run_targets(_plan(spark, sf), given.second_inventory(spark, sf))
    )


@query
def plan_dry_run_targets(spark, sf):
    return cleanup.dry_run_targets(_plan(spark, sf), given.second_inventory(spark, sf))


@query
def plan_directory_size(spark, sf):
    targets = _spaces(spark, sf).select("path")
    return cleanup.directory_sizes(targets, _rollup(spark, sf))


@query
def action_transitions(spark, sf):
    checked = cleanup.check_transitions(cleanup.transitions(given.action_events(spark, sf)))
    return checked.select(
        "action_id", "event_id", "from_status", "to_status",
        F.col("is_allowed").cast("int").alias("is_allowed"),
    )


@query
def action_transition_violations(spark, sf):
    changes = cleanup.transitions(given.action_events(spark, sf))
    return cleanup.transition_violations(changes).select(
        "action_id", "event_id", "from_status", "to_status"
    )


@query
def action_state(spark, sf):
    return cleanup.action_states(given.action_events(spark, sf)).select(
        "action_id", "status", "event_count"
    )


@query
def action_outcome(spark, sf):
    return cleanup.action_outcomes(given.action_results(spark, sf))


@query
def rollback_outcome(spark, sf):
    return cleanup.rollback_outcomes(given.action_results(spark, sf))


@query
def action_list(spark, sf):
    states = cleanup.action_states(given.action_events(spark, sf))
    listed = cleanup.filter_actions(states, "approved")
    return paging.page(listed, cleanup.action_order(), 1, 25).select(
        "action_id", "status", ts_text("updated_at").alias("updated_at")
    )


@query
def audit_append(spark, sf):
    """Appends two halves of the log and reads the whole."""
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    records = audit.audit_records(given.audit_source(spark, sf))
    tables.append(records.where("severity = 'info'"), folder)
    tables.append(records.where("severity <> 'info'"), folder)
    return spark.read.parquet(folder).groupBy("action", "severity").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum("bytes_affected").alias("bytes_affected")
    )


@query
def audit_query(spark, sf):
    log = audit.audit_records(given.audit_source(spark, sf))
    found = audit.query_audit(log, severity="error", correlation_id="corr-7")
    return paging.page(found, audit.audit_order(), 1, 50).select(
        "log_id", "correlation_id", "action", "description", "bytes_affected", "severity",
        ts_text("created_at").alias("created_at"),
    )


@query
def task_progress(spark, sf):
    return progress.task_progress(given.task_events(spark, sf)).select(
        "task_id", "event_id", "event_type", "files_per_second", "event_count",
        F.col("is_terminal").cast("int").alias("is_terminal"),
    )


@query
def task_events_after(spark, sf):
    return progress.events_after(given.task_events(spark, sf), "8", 500).select(
        "task_id", "event_id", "event_type",
        F.col("is_terminal").cast("int").alias("is_terminal"),
    )


@query
def task_progress_windows(spark, sf):
    return progress.progress_windows(given.task_events(spark, sf)).withColumn(
        "window_start", ts_text("window_start")
    )


@query
def task_progress_stream(spark, sf):
    """The same windows from a stream that runs until the input is used up."""
    return streams.progress_windows_once(spark, sf).withColumn(
        "window_start", ts_text("window_start")
    )


QUERIES["overview"] = _overview


@query
def task_ended_stream(spark, sf):
    """Tasks closed by a timer after their last event, from the stream of all events."""
    ended = task_streams.ended_tasks_once(spark, sf)
    return ended.select("task_id", "event_id", "event_type", "event_count", "ended_micros",
                        F.col("is_terminal").cast("int").alias("is_terminal"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
