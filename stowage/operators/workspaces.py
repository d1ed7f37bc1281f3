"""Developer workspaces: artifacts, roots, activity and look-alikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage import fixed_values as V
from stowage.functions.once import computed_once
from stowage.functions.paths import file_name
from stowage.functions.projects import (
    artifact_rule, inactivity_bucket, model_extension, project_name_key, rule_value,
    searchable, workspace_risk, workspace_root,
)
from stowage.functions.times import whole_days_since
from stowage.operators.breakdowns import of_scan
from stowage.operators.paging import where_all
from stowage.operators.skew import join_by_key


def _directory(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(file_name(path)) - 1)


def artifact_files(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Files in a build or cache folder, and model files elsewhere, with their root.

    A single projection and filter: no join with the patterns.
    """
    path, rule = F.col("path"), F.col("_rule")
    rows = of_scan(files, scan_id).select("scan_id", "file_id", "path", "size_bytes", "modified_at")
    rows = computed_once(rows, path=path, _searched=searchable(path))
    rows = computed_once(rows, _rule=artifact_rule("_searched")).drop("_searched")
    is_model = rule.isNull() & model_extension(path).isin(V.MODEL_EXTENSIONS)
    return (
        rows.withColumn("is_model", F.coalesce(is_model, F.lit(False)))
        .where(rule.isNotNull() | F.col("is_model"))
        .select(
            "scan_id", "file_id", "path", "size_bytes", "modified_at", "is_model",
            F.when(F.col("is_model"), _directory(path))
            .otherwise(workspace_root("path", "_rule")).alias("root"),
            F.when(F.col("is_model"), "ml").otherwise(rule_value("_rule", 1)).alias("workspace_type"),
            F.when(F.col("is_model"), "ml_model")
            .otherwise(rule_value("_rule", 2)).alias("artifact_type"),
            F.when(F.col("is_model"), "medium").otherwise(rule_value("_rule", 3)).alias("risk_level"),
            F.when(F.col("is_model"), False).otherwise(rule_value("_rule", 4)).alias("is_safe"),
        )
    )


def model_files(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    return artifact_files(files, scan_id).where("is_model")


def artifact_groups(artifacts: DataFrame) -> DataFrame:
    """Sums per root and artifact type: the map-side reduced input of all below."""
    newest_type = F.max(
        F.when(~F.col("is_model"), F.struct("file_id", "workspace_type"))
    )
    return artifacts.groupBy("scan_id", "root", "artifact_type").agg(
        F.sum("size_bytes").alias("total_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.sum(F.when(F.col("is_safe"), F.col("size_bytes")).otherwise(0)).alias("safe_bytes"),
        F.max("modified_at").alias("last_modified_at"),
        F.bool_or("is_model").alias("has_models"),
        newest_type.alias("_newest"),
    )


def workspaces(artifacts: DataFrame) -> DataFrame:
    """One row per root. The type is that of the last file by id; models win.

    The artifact list has one entry per artifact type, so it stays short.
    """
    entry = F.struct(
        (-F.col("total_bytes")).alias("order"),
        F.col("artifact_type").alias("type"),
        F.col("total_bytes"),
        F.col("file_count"),
    )
    per_root = artifact_groups(artifacts).groupBy("scan_id", "root").agg(
        F.sum("total_bytes").alias("total_size_bytes"),
        F.sum("total_bytes").alias("recoverable_bytes"),
        F.sum("safe_bytes").alias("safe_recoverable_bytes"),
        F.sum("file_count").alias("file_count"),
        F.max("last_modified_at").alias("last_modified_at"),
        F.when(F.bool_or("has_models"), "ml")
        .otherwise(F.max("_newest")["workspace_type"]).alias("workspace_type"),
        F.array_sort(F.collect_list(entry)).alias("_entries"),
    )
    return per_root.select(
        "scan_id",
        F.col("root").alias("path"),
        file_name(F.col("root")).alias("name"),
        "workspace_type",
        "total_size_bytes",
        "recoverable_bytes",
        "safe_recoverable_bytes",
        "file_count",
        "last_modified_at",
        workspace_risk(F.col("workspace_type")).alias("risk_level"),
        F.transform(
            "_entries",
            lambda e: F.struct(
                e["type"].alias("type"),
                e["total_bytes"].alias("total_bytes"),
                e["file_count"].alias("file_count"),
            ),
        ).alias("artifacts"),
    )


def workspace_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifact_groups(artifacts).select(
        "scan_id", F.col("root").alias("path"), "artifact_type", "total_bytes", "file_count"
    )


def with_activity(
    spaces: DataFrame, as_of: str | Column, threshold_days: int = V.INACTIVE_DAYS
) -> DataFrame:
    """Adds the days since the last change and the activity flag."""
    days = F.coalesce(
        whole_days_since(F.col("last_modified_at"), as_of), F.lit(V.UNKNOWN_INACTIVE_DAYS)
    )
    return spaces.withColumn("days_inactive", days).withColumn(
        "is_active", F.col("days_inactive") < threshold_days
    )


def with_project_bytes(spaces: DataFrame, rollup: DataFrame) -> DataFrame:
    """Adds the bytes of the whole project folder, beyond its artifacts."""
    sizes = rollup.select("scan_id", "path", F.col("total_size_bytes").alias("project_total_bytes"))
    return spaces.join(sizes, ["scan_id", "path"], "left")


def workspace_summary(spaces: DataFrame) -> DataFrame:
    """Counts and bytes per type, and a row with type NULL for the total."""
    return spaces.rollup("workspace_type").agg(
        F.count(F.lit(1)).alias("workspace_count"),
        F.coalesce(F.sum("total_size_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias("recoverable_bytes"),
        F.coalesce(F.sum("safe_recoverable_bytes"), F.lit(0)).alias("safe_recoverable_bytes"),
        F.count_if(~F.col("is_active")).alias("inactive_count"),
    )


def recovery_split(spaces: DataFrame) -> DataFrame:
    """Potential, safe and high-risk bytes per type."""
    return spaces.groupBy("workspace_type").agg(
        F.sum("recoverable_bytes").alias("potential_bytes"),
        F.sum("safe_recoverable_bytes").alias("safe_bytes"),
        (F.sum("recoverable_bytes") - F.sum("safe_recoverable_bytes")).alias("high_risk_bytes"),
    )


def filter_workspaces(
    spaces: DataFrame,
    workspace_type: str | None = None,
    is_active: bool | None = None,
    min_size: int | None = None,
) -> DataFrame:
    return where_all(
        spaces,
        [
            None if workspace_type is None else F.col("workspace_type") == workspace_type,
            None if is_active is None else F.col("is_active") == is_active,
            None if min_size is None else F.col("recoverable_bytes") >= min_size,
        ],
    )


def workspace_order() -> list[Column]:
    return [F.col("recoverable_bytes").desc(), F.col("path")]


def abandoned_projects(spaces: DataFrame) -> DataFrame:
    """Inactive workspaces, each with the count and bytes of all of them."""
    inactive = spaces.where(~F.col("is_active"))
    totals = inactive.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("recoverable_bytes"), F.lit(0)).alias("b")
        ).alias("t")
    ).scalar()
    return inactive.withColumn("_t", totals).select(
        *inactive.columns,
        F.col("_t.n").alias("abandoned_count"),
        F.col("_t.b").alias("abandoned_bytes"),
    )


def lookalike_projects(spaces: DataFrame) -> DataFrame:
    """Workspaces whose names differ only in copy suffixes, one row each."""
    named = spaces.withColumn("name_key", project_name_key(F.col("name"))).where("name_key <> ''")
    sizes = (
        named.groupBy("name_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )
    return join_by_key(named, sizes, "name_key", "group_size", "path")


def inactivity_report(spaces: DataFrame) -> DataFrame:
    """Workspaces and bytes by how long they were left alone."""
    return spaces.groupBy(inactivity_bucket(F.col("days_inactive")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("workspace_count"),
        F.sum("recoverable_bytes").alias("recoverable_bytes"),
    )


def download_bloat(
    files: DataFrame,
    as_of: str | Column,
    folder: str = "Downloads",
    min_days: int = V.STALE_DAYS,
    extensions: list[str] | None = None,
) -> DataFrame:
    """Old archives, installers, disk images and PDFs below a download folder."""
    return files.where(
        F.array_contains(F.split("directory", "/"), folder)
        & F.col("extension").isin(extensions or V.DOWNLOAD_EXTENSIONS)
        & (whole_days_since(F.col("modified_at"), as_of) >= min_days)
    )


def model_hoarding(artifacts: DataFrame) -> DataFrame:
    """Folders with several model files, and the bytes beyond the newest one."""
    models = artifacts.where("is_model")
    newest = F.max(F.struct("modified_at", "file_id", "size_bytes"))
    return (
        models.groupBy("scan_id", F.col("root").alias("path"))
        .agg(
            F.count(F.lit(1)).alias("model_count"),
            F.sum("size_bytes").alias("total_bytes"),
            newest["file_id"].alias("newest_file_id"),
            (F.sum("size_bytes") - newest["size_bytes"]).alias("redundant_bytes"),
        )
        .where("model_count > 1")
    )
