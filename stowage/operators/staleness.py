"""Staleness of files: scores, tiers, risk and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stowage.fixed_values import ARTIFACT_LIKE_PATTERNS, TIER_NAMES
from stowage.functions.scoring import (
    in_artifact_directory, is_stale, risk_level, stale_score, tier_by_age, tier_by_score,
)
from stowage.functions.times import days_since
from stowage.operators.breakdowns import of_scan
from stowage.operators.paging import where_all
from stowage.operators.skew import join_by_key


def score_files(files: DataFrame, as_of: str | Column) -> DataFrame:
    """Adds ages, score, risk, tier and the stale flag; no shuffle."""
    return (
        files.withColumn("days_access", days_since(F.col("accessed_at"), as_of))
        .withColumn("days_modify", days_since(F.col("modified_at"), as_of))
        .withColumn("stale_score", stale_score(F.col("days_access"), F.col("days_modify")))
        .withColumn("is_stale", is_stale(F.col("stale_score")))
        .withColumn("tier", tier_by_score(F.col("stale_score")))
        .withColumn("is_artifact", in_artifact_directory(F.col("path")))
        .withColumn(
            "risk_level",
            risk_level(F.col("category"), F.col("stale_score"), F.col("is_artifact")),
        )
    )


def freshness_by_age(
    files: DataFrame, as_of: str | Column, active: float = 30, aging: float = 180, stale: float = 365
) -> DataFrame:
    """Files and bytes per tier of the access age, with limits as parameters."""
    tier = tier_by_age(days_since(F.col("accessed_at"), as_of), active, aging, stale)
    return files.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes")
    )


def stale_summary(scored: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Files and bytes of all four tiers, absent ones as 0, with the totals.

    One pass with conditional sums gives one row, which is then unfolded.
    """
    rows = of_scan(scored, scan_id)
    sums = []
    for name in TIER_NAMES:
        inside = F.col("tier") == name
        sums += [
            F.count_if(inside).alias(f"n_{name}"),
            F.coalesce(F.sum(F.when(inside, F.col("size_bytes"))), F.lit(0)).alias(f"b_{name}"),
        ]
    one = rows.agg(*sums)
    tiers = F.array(
        *[
            F.struct(
                F.lit(name).alias("tier"),
                F.col(f"n_{name}").alias("file_count"),
                F.col(f"b_{name}").alias("total_bytes"),
            )
            for name in TIER_NAMES
        ]
    )
    return one.select(
        F.inline(tiers),
        (F.col("b_stale") + F.col("b_archive_candidate")).alias("recoverable_bytes"),
        (F.col("n_stale") + F.col("n_archive_candidate")).alias("total_stale_files"),
    )


def stale_risk_breakdown(scored: DataFrame, scan_id: str | None = None) -> DataFrame:
    return (
        of_scan(scored, scan_id)
        .where("is_stale")
        .groupBy(F.coalesce("risk_level", F.lit("unscored")).alias("risk_level"))
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    )


def stale_files(
    scored: DataFrame,
    tier: str | None = None,
    risk: str | None = None,
    category: str | None = None,
    min_size: int | None = None,
) -> DataFrame:
    """Stale files that meet all given filters."""
    return where_all(
        scored.where("is_stale"),
        [
            None if tier is None else F.col("tier") == tier,
            None if risk is None else F.col("risk_level") == risk,
            None if category is None else F.col("category") == category,
            None if min_size is None else F.col("size_bytes") >= min_size,
        ],
    )


def stale_order() -> list[Column]:
    return [F.col("stale_score").desc(), F.col("size_bytes").desc(), F.col("path"), F.col("file_id")]


def artifact_summary(files: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Files and bytes per artifact type; a file counts for each pattern it matches.

    All patterns are tested in one pass over the files.
    """
    rows = of_scan(files, scan_id)
    names = list(dict.fromkeys(name for name, _ in ARTIFACT_LIKE_PATTERNS))
    sums = []
    for name in names:
        hits = [
            F.when(F.col("path").ilike(pattern), 1).otherwise(0)
            for kind, pattern in ARTIFACT_LIKE_PATTERNS
            if kind == name
        ]
        times = reduce(lambda a, b: a + b, hits)
        sums += [
            F.coalesce(F.sum(times), F.lit(0)).cast("bigint").alias(f"n_{name}"),
            F.coalesce(F.sum(times * F.col("size_bytes")), F.lit(0)).alias(f"b_{name}"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("artifact_type"),
                F.col(f"n_{name}").alias("file_count"),
                F.col(f"b_{name}").alias("total_bytes"),
            )
            for name in names
        ]
    )
    return rows.agg(*sums).select(F.inline(entries)).where(F.col("file_count") > 0)


def artifact_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_recoverable_bytes"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_artifact_files"),
    )


def orphaned_files(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files whose scan is not in the register any more.

    The scans are compared first, one row each; a scan that holds a large part
    of all files is then looked up in pieces.
    """
    lost = (
        files.groupBy("scan_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(scans.select("scan_id").distinct(), "scan_id", "left_anti")
    )
    return join_by_key(files, lost, "scan_id", "_n", "file_id").select(*files.columns)
