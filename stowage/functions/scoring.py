"""Staleness, risk and priority as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage import fixed_values as V
from stowage.functions.paths import sql_list


def stale_score(access_days: Column, modify_days: Column) -> Column:
    """0 (fresh) to 1 (long unused): a sigmoid of the weighted age."""
    age = access_days * V.ACCESS_WEIGHT + modify_days * V.MODIFY_WEIGHT
    sigmoid = F.lit(1.0) / (
        F.lit(1.0) + F.exp(F.lit(-V.SIGMOID_STEEPNESS) * (age - V.SIGMOID_MIDPOINT_DAYS))
    )
    return F.when((access_days <= 0) & (modify_days <= 0), 0.0).otherwise(F.round(sigmoid, 4))


def is_stale(score: Column) -> Column:
    return score >= V.STALE_SCORE


def tier_by_age(
    days: Column,
    active: float = V.ACTIVE_DAYS,
    aging: float = V.AGING_DAYS,
    stale: float = V.STALE_DAYS,
) -> Column:
    """Freshness tier from the age alone, with inclusive upper limits."""
    return (
        F.when(days <= active, "active")
        .when(days <= aging, "aging")
        .when(days <= stale, "stale")
        .otherwise("archive_candidate")
    )


def tier_by_score(score: Column) -> Column:
    """Freshness tier from the score, as reports use it; no score is active."""
    chain = F.when(score.isNull(), V.TIER_NAMES[0])
    for name, below in V.SCORE_TIERS:
        chain = chain.when(score < below, name)
    return chain.otherwise(V.TIER_NAMES[-1])


def in_artifact_directory(path: Column, names: list[str] | None = None) -> Column:
    """Whether any component of the path is the name of a build or cache folder."""
    wanted = F.expr(f"array({sql_list(names or V.ARTIFACT_DIRECTORIES)})")
    return F.arrays_overlap(F.split(path, "/"), wanted)


def risk_level(category: Column, score: Column, is_artifact: Column) -> Column:
    """How dangerous a deletion would be."""
    kind = F.coalesce(category, F.lit("other"))
    return (
        F.when(is_artifact, "low")
        .when(
            kind.isin(V.HIGH_RISK_CATEGORIES),
            F.when(score < 0.5, "high").when(score < 0.8, "medium").otherwise("low"),
        )
        .when(kind.isin(V.LOW_RISK_CATEGORIES), "low")
        .when(score < 0.5, "medium")
        .otherwise("low")
    )


def priority_sql(size: str, risk: str) -> str:
    """SQL for the priority of a recommendation from its bytes and its risk."""
    return (
        f"CASE WHEN {size} >= {50 * V.GIB} AND {risk} = 'low' THEN 'critical' "
        f"WHEN {size} >= {5 * V.GIB} THEN 'high' "
        f"WHEN {size} >= {V.GIB} AND {risk} = 'low' THEN 'high' "
        f"WHEN {size} >= {V.GIB // 2} THEN 'medium' ELSE 'low' END"
    )


def priority_of(size: str, risk: str) -> Column:
    """Priority from two columns, given by name or as SQL."""
    return F.expr(priority_sql(size, risk))


def priority_rank(priority: Column) -> Column:
    chain = None
    for rank, name in enumerate(V.PRIORITY_ORDER):
        test = priority == name
        chain = F.when(test, rank) if chain is None else chain.when(test, rank)
    return chain.otherwise(99)


def trend_of(daily_growth: Column, total: Column) -> Column:
    """Growth class from the monthly growth in percent of the total."""
    monthly_pct = daily_growth * 30 / total * 100
    chain = F.when((total <= 0) | (daily_growth <= 0), "stable")
    for name, below in V.TREND_LIMITS:
        chain = chain.when(monthly_pct < below, name)
    return chain.otherwise("critical_growth")
