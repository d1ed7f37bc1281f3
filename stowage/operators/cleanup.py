"""Cleanup plans: proposals, checks, states and outcomes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from stowage.fixed_values import ACTION_TYPES, ALLOWED_TRANSITIONS
from stowage.operators.breakdowns import of_scan
from stowage.operators.paging import where_all


def propose(targets: DataFrame, action_id: str | Column, action_type: str) -> DataFrame:
    """One plan row per target: (action_id, action_type, path, size_bytes)."""
    if action_type not in ACTION_TYPES:
        raise ValueError(f"action type is one of {ACTION_TYPES}")
    name = F.lit(action_id) if isinstance(action_id, str) else action_id
    return targets.select(
        name.alias("action_id"), F.lit(action_type).alias("action_type"), "path", "size_bytes"
    )


def proposal_totals(plan: DataFrame) -> DataFrame:
    """Targets and bytes per action. An action without targets has no row."""
    return plan.groupBy("action_id", "action_type").agg(
        F.count(F.lit(1)).alias("target_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.lit("proposed").alias("status"),
    )


def dry_run_targets(
    plan: DataFrame,
    inventory: DataFrame,
    rollup: DataFrame | None = None,
    scan_id: str | None = None,
) -> DataFrame:
    """Checks each target against a fresh inventory: ready with its size, or missing.

    With a folder rollup, targets that are folders count with all below them.
    Of an inventory with several scans the wanted one is named; a path that
    still occurs more than once counts once, with its largest size.
    """
    present = of_scan(inventory, scan_id).select("path", F.col("size_bytes").alias("_size"))
    if rollup is not None:
        present = present.unionByName(
            of_scan(rollup, scan_id).select("path", F.col("total_size_bytes").alias("_size"))
        )
    present = present.groupBy("path").agg(F.max("_size").alias("_size"))
    joined = plan.join(present, "path", "left")
    return joined.select(
        "action_id",
        "path",
        F.when(F.col("_size").isNull(), "missing").otherwise("ready").alias("status"),
        F.coalesce("_size", F.lit(0)).alias("size_bytes"),
    )


def dry_run(checked: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    return checked.groupBy("action_id").agg(
        F.count_if(ready).alias("valid_count"),
        F.count_if(~ready).alias("missing_count"),
        F.sum("size_bytes").alias("valid_bytes"),
    )


def directory_sizes(targets: DataFrame, rollup: DataFrame) -> DataFrame:
    """Recursive bytes of each target folder, by scan where both tables know it."""
    key = [c for c in ("scan_id", "path") if c in targets.columns and c in rollup.columns]
    return targets.join(rollup.select(*key, "total_size_bytes", "file_count"), key)


def transitions(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Each status change with the status before it, per action.

    The events of one action may be very many, so they are not ordered in one
    window. Each (action, time bucket) is ordered by itself; the status that
    enters a bucket comes from a second window over one row per bucket.
    """
    rows = events.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    inside = W.partitionBy("action_id", "_bucket").orderBy("ts", "event_id")
    last = F.max(F.struct("ts", "event_id", "status"))["status"]
    across = W.partitionBy("action_id").orderBy("_bucket")
    entering = (
        rows.groupBy("action_id", "_bucket")
        .agg(last.alias("_last"))
        .withColumn("_entering", F.lag("_last").over(across))
        .select("action_id", "_bucket", "_entering")
    )
    return (
        rows.withColumn("_prior", F.lag("status").over(inside))
        .join(entering, ["action_id", "_bucket"])
        .select(
            "action_id", "event_id", "ts",
            F.coalesce("_prior", "_entering").alias("from_status"),
            F.col("status").alias("to_status"),
        )
    )


def _is_allowed() -> Column:
    pair = F.concat_ws(">", "from_status", "to_status")
    allowed = pair.isin([f"{a}>{b}" for a, b in ALLOWED_TRANSITIONS])
    first = F.col("from_status").isNull() & (F.col("to_status") == "proposed")
    return first | (F.col("from_status").isNotNull() & allowed)


def check_transitions(changes: DataFrame) -> DataFrame:
    return changes.withColumn("is_allowed", _is_allowed())


def transition_violations(changes: DataFrame) -> DataFrame:
    return changes.where(~_is_allowed())


def action_states(events: DataFrame) -> DataFrame:
    """The current status of each action."""
    newest = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("action_id").agg(
        newest["status"].alias("status"), newest["ts"].alias("updated_at"),
        F.count(F.lit(1)).alias("event_count"),
    )


def action_outcomes(results: DataFrame) -> DataFrame:
    """Moved files and bytes per executed action, with its final status.

    ``results`` has (action_id, path, size_bytes, succeeded).
    """
    moved = F.count_if("succeeded")
    errors = F.count_if(~F.col("succeeded"))
    return results.groupBy("action_id").agg(
        F.when((moved == 0) & (F.count(F.lit(1)) > 0), "failed").otherwise("completed").alias("status"),
        moved.alias("files_processed"),
        F.coalesce(F.sum(F.when(F.col("succeeded"), F.col("size_bytes"))), F.lit(0))
        .alias("bytes_recovered"),
        errors.alias("errors"),
        F.when((moved > 0) & (errors > 0), F.concat(errors.cast("string"), F.lit(" files skipped")))
        .alias("message"),
    )


def rollback_outcomes(results: DataFrame) -> DataFrame:
    """Restored files and bytes per rolled-back action."""
    return results.groupBy("action_id").agg(
        F.lit("rolled_back").alias("status"),
        F.count_if("succeeded").alias("files_restored"),
        F.coalesce(F.sum(F.when(F.col("succeeded"), F.col("size_bytes"))), F.lit(0))
        .alias("bytes_restored"),
        F.count_if(~F.col("succeeded")).alias("errors"),
    )


def filter_actions(actions: DataFrame, status: str | None = None) -> DataFrame:
    return where_all(actions, [None if status is None else F.col("status") == status])


def action_order() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("action_id")]
