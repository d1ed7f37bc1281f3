"""Rule-based recommendations from one context row per scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from stowage import fixed_values as V
from stowage.functions.paths import sql_list
from stowage.functions.scoring import priority_rank, priority_sql
from stowage.functions.texts import human_bytes_sql
from stowage.operators.overview import merge_by_scan
from stowage.operators.paging import where_all

COLUMNS = [
    "category", "priority", "title", "description", "explanation", "confidence", "risk_level",
    "recoverable_bytes", "affected_count", "affected_paths", "subject",
]


def context(
    groups: DataFrame,
    members: DataFrame,
    scored: DataFrame,
    spaces: DataFrame,
    free_bytes: DataFrame | None = None,
    growth: DataFrame | None = None,
    top_files: int = 20,
) -> DataFrame:
    """What the rules look at, from stored duplicate groups and members; see ``context_of``."""
    by_extension = (
        members.where(F.col("extension").isNotNull())
        .groupBy("scan_id", "extension")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    extension_list = _top_list(by_extension, "n", "extension", 5).groupBy("scan_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "extension"))),
            lambda e: e["extension"],
        ).alias("top_extensions")
    )
    totals = groups.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.sum("member_count").alias("duplicate_files"),
        F.sum("wasted_bytes").alias("wasted_bytes"),
    )
    return context_of([totals, extension_list], scored, spaces, free_bytes, growth, top_files)


def context_of(
    duplicates: list[DataFrame],
    scored: DataFrame,
    spaces: DataFrame,
    free_bytes: DataFrame | None = None,
    growth: DataFrame | None = None,
    top_files: int = 20,
) -> DataFrame:
    """What the rules look at: one row per scan of the scored inventory.

    ``duplicates`` are rows per scan with duplicate_groups, duplicate_files,
    wasted_bytes and top_extensions, as ``duplicate_totals`` gives them in one pass.
    ``free_bytes`` is (scan_id, free_storage) and ``growth`` is
    (scan_id, daily_growth_bytes). Lists in the row are short by nature: five
    extensions, one entry per workspace type and the largest files.
    """
    stale, archive = F.col("tier") == "stale", F.col("tier") == "archive_candidate"
    large = F.coalesce(F.col("size_bytes") > V.GIB, F.lit(False))
    tiers = scored.groupBy("scan_id").agg(
        F.sum("size_bytes").alias("total_bytes"),
        F.sum(F.when(stale, F.col("size_bytes")).otherwise(0)).alias("stale_bytes"),
        F.count_if(stale).alias("stale_count"),
        F.sum(F.when(archive, F.col("size_bytes")).otherwise(0)).alias("archive_bytes"),
        F.count_if(archive).alias("archive_count"),
        F.sum(F.when(large, F.col("size_bytes")).otherwise(0)).alias("large_file_bytes"),
        F.count_if(large).alias("large_file_count"),
    )
    types = spaces.groupBy("scan_id", "workspace_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("recoverable_bytes").alias("recoverable_bytes"),
        F.sum("safe_recoverable_bytes").alias("safe_bytes"),
        F.count_if(~F.col("is_active")).alias("inactive"),
    )
    workspaces = types.groupBy("scan_id").agg(
        F.sum("count").alias("workspace_count"),
        F.sum("recoverable_bytes").alias("workspace_bytes"),
        F.sum("safe_bytes").alias("workspace_safe_bytes"),
        F.sum("inactive").alias("inactive_workspaces"),
        F.array_sort(
            F.collect_list(F.struct("workspace_type", "count", "recoverable_bytes"))
        ).alias("by_type"),
    )
    largest = _top_list(
        scored.select("scan_id", "path", "size_bytes"), "size_bytes", "path", top_files
    ).groupBy("scan_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("size_bytes")).alias("o"), "path"))),
            lambda e: F.struct(e["path"].alias("path"), (-e["o"]).alias("size_bytes")),
        ).alias("largest_files")
    )
    parts = [*duplicates, tiers, workspaces, largest]
    zero = F.lit(0).cast("bigint")
    defaults = {
        name: zero
        for name in (
            "duplicate_groups", "duplicate_files", "wasted_bytes", "stale_bytes", "stale_count",
            "archive_bytes", "archive_count", "workspace_count", "workspace_bytes",
            "workspace_safe_bytes", "inactive_workspaces", "free_storage", "large_file_bytes",
            "large_file_count",
        )
    }
    blank = scored.sparkSession.range(0).select(
        F.lit("").alias("scan_id"), zero.alias("free_storage"), F.lit(0.0).alias("daily_growth_bytes")
    )
    parts.append(blank)
    if free_bytes is not None:
        parts.append(free_bytes.select("scan_id", F.col("free_storage").cast("bigint")))
    if growth is not None:
        parts.append(growth.select("scan_id", F.col("daily_growth_bytes").cast("double")))
    return merge_by_scan(parts, {**defaults, "daily_growth_bytes": F.lit(0.0)})


def _top_list(rows: DataFrame, weight: str, tiebreak: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each scan; ranks are cut before the shuffle."""
    order = W.partitionBy("scan_id").orderBy(F.col(weight).desc(), F.col(tiebreak))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)


def _text(template: str, values: dict[str, str]) -> str:
    """SQL filling the names in braces with expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        values[piece] if i % 2 else "'" + piece.replace("'", "\\'") + "'"
        for i, piece in enumerate(pieces)
        if piece
    ]
    return f"concat({', '.join(parts)})"


def _when(
    condition: str,
    key: str,
    category: str,
    priority: str,
    confidence: float,
    risk: str,
    size: str,
    count: str,
    values: dict[str, str],
    paths: str = "CAST(array() AS ARRAY<STRING>)",
    subject: str | None = None,
) -> str:
    """SQL for one recommendation, NULL where the condition does not hold."""
    title, description, explanation = V.RECOMMENDATION_TEXTS[key]
    return f"""CASE WHEN {condition} THEN named_struct(
        'category', '{category}', 'priority', {priority},
        'title', {_text(title, values)}, 'description', {_text(description, values)},
        'explanation', {_text(explanation, values)},
        'confidence', CAST({confidence} AS DOUBLE), 'risk_level', {risk},
        'recoverable_bytes', CAST({size} AS BIGINT), 'affected_count', CAST({count} AS BIGINT),
        'affected_paths', {paths}, 'subject', {subject or f"'{key}'"}) END"""


# Each rule is SQL for an array of recommendations over the context's columns.


def growth_warning() -> str:
    days = "try_divide(CAST(free_storage AS DOUBLE), daily_growth_bytes)"
    rec = _when(
        f"daily_growth_bytes > 0 AND free_storage > 0 AND {days} <= 180",
        "growth_warning", "growth_warning",
        f"CASE WHEN {days} < 30 THEN 'critical' WHEN {days} < 90 THEN 'high' ELSE 'medium' END",
        0.70, f"if({days} < 60, 'high', 'medium')", "0", "0",
        {
            "days": f"CAST({days} AS BIGINT)",
            "monthly": human_bytes_sql("CAST(daily_growth_bytes * 30 AS BIGINT)"),
            "free": human_bytes_sql("free_storage"),
            "daily": human_bytes_sql("CAST(daily_growth_bytes AS BIGINT)"),
        },
    )
    return f"array({rec})"


def duplicate_cleanup() -> str:
    names = "array_join(slice(top_extensions, 1, 5), ', ')"
    rec = _when(
        f"duplicate_groups > 0 AND wasted_bytes >= {100 * V.KIB}",
        "duplicates", "duplicate_cleanup", priority_sql("wasted_bytes", "'low'"), 0.95, "'low'",
        "wasted_bytes", "duplicate_files",
        {
            "groups": "duplicate_groups",
            "wasted": human_bytes_sql("wasted_bytes"),
            "extensions": f"coalesce(nullif({names}, ''), 'various')",
        },
    )
    return f"array({rec})"


def workspace_cleanup() -> str:
    rest = "greatest(workspace_bytes - workspace_safe_bytes, 0)"
    regenerable = _when(
        f"workspace_safe_bytes > {10 * V.MIB}",
        "regenerable", "workspace_cleanup", priority_sql("workspace_safe_bytes", "'low'"),
        0.97, "'low'", "workspace_safe_bytes", "workspace_count",
        {"safe": human_bytes_sql("workspace_safe_bytes")},
    )
    abandoned = _when(
        "inactive_workspaces >= 2",
        "abandoned", "workspace_cleanup", priority_sql(rest, "'medium'"), 0.80, "'medium'",
        rest, "inactive_workspaces", {"inactive": "inactive_workspaces"},
    )
    of_type = _when(
        f"t.recoverable_bytes > {100 * V.MIB}",
        "workspace_type", "workspace_cleanup", "'high'", 0.90,
        f"if(t.workspace_type IN ({sql_list(V.REGENERABLE_WORKSPACES)}), 'low', 'medium')",
        "t.recoverable_bytes", "t.count",
        {
            "type": "t.workspace_type",
            "recoverable": human_bytes_sql("t.recoverable_bytes"),
            "count": "t.count",
        },
        subject="concat('workspace_type:', t.workspace_type)",
    )
    return f"array({regenerable}, {abandoned}), transform(by_type, t -> {of_type})"


def stale_cleanup() -> str:
    archive = _when(
        f"archive_bytes > {V.MIB}",
        "archive", "archive", priority_sql("archive_bytes", "'low'"), 0.88, "'low'",
        "archive_bytes", "archive_count",
        {"count": "archive_count", "bytes": human_bytes_sql("archive_bytes")},
    )
    stale = _when(
        f"stale_bytes > {5 * V.MIB}",
        "stale", "stale_cleanup", priority_sql("stale_bytes", "'medium'"), 0.72, "'medium'",
        "stale_bytes", "stale_count",
        {"count": "stale_count", "bytes": human_bytes_sql("stale_bytes")},
    )
    return f"array({archive}, {stale})"


def large_file_review() -> str:
    rec = _when(
        "large_file_count > 0",
        "large_files", "large_file", priority_sql("large_file_bytes", "'medium'"), 0.65, "'medium'",
        "large_file_bytes", "large_file_count",
        {"count": "large_file_count", "bytes": human_bytes_sql("large_file_bytes")},
        paths="slice(transform(large_files, f -> f.path), 1, 20)",
    )
    return f"array({rec})"


RULES = [growth_warning, duplicate_cleanup, workspace_cleanup, stale_cleanup, large_file_review]


def recommendations(contexts: DataFrame, rules: list | None = None) -> DataFrame:
    """All recommendations of each scan, still pending.

    Every rule is an expression giving a short list, so the context is
    computed once and no rule can make the others fail.
    """
    empty_types = (
        "CAST(array() AS ARRAY<STRUCT<workspace_type: STRING, count: BIGINT, "
        "recoverable_bytes: BIGINT>>)"
    )
    empty_files = "CAST(array() AS ARRAY<STRUCT<path: STRING, size_bytes: BIGINT>>)"
    rows = contexts.withColumns(
        {
            "top_extensions": F.expr("coalesce(top_extensions, CAST(array() AS ARRAY<STRING>))"),
            "by_type": F.expr(f"coalesce(by_type, {empty_types})"),
            "large_files": F.expr(
                f"filter(coalesce(largest_files, {empty_files}), f -> f.size_bytes > {V.GIB})"
            ),
        }
    )
    lists = ", ".join(rule() for rule in rules or RULES)
    made = rows.select(
        "scan_id", F.expr(f"inline(filter(concat({lists}), r -> r IS NOT NULL))")
    )
    return made.select(
        F.concat_ws("/", "scan_id", "category", "subject").alias("recommendation_id"),
        "scan_id",
        *[c for c in COLUMNS if c != "subject"],
        F.lit("pending").alias("status"),
    )


def recommendation_order() -> list[Column]:
    return [
        priority_rank(F.col("priority")), F.col("recoverable_bytes").desc(),
        F.col("recommendation_id"),
    ]


def filter_recommendations(
    recs: DataFrame,
    status: str | None = None,
    priority: str | None = None,
    category: str | None = None,
) -> DataFrame:
    return where_all(
        recs,
        [
            None if status is None else F.col("status") == status,
            None if priority is None else F.col("priority") == priority,
            None if category is None else F.col("category") == category,
        ],
    )


def recommendation_detail(recs: DataFrame, recommendation_id: str) -> DataFrame:
    return recs.where(F.col("recommendation_id") == recommendation_id)


def apply_decisions(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status and reason from the newest decision on each recommendation.

    ``decisions`` has (recommendation_id, status, reason, decided_at).
    """
    newest = decisions.groupBy("recommendation_id").agg(
        F.max(F.struct("decided_at", "status", "reason")).alias("_d")
    )
    joined = recs.join(newest, "recommendation_id", "left")
    return joined.withColumn("status", F.coalesce("_d.status", "status")).withColumn(
        "dismissed_reason", F.when(F.col("status") == "dismissed", F.col("_d.reason"))
    ).drop("_d")


def unknown_decisions(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on recommendations that do not exist."""
    return decisions.join(recs.select("recommendation_id"), "recommendation_id", "left_anti")
