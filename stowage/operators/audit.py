"""The audit table: append-only records of operations and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.operators.paging import where_all

# Fixed value: how many affected paths a record shows.
SHOWN_PATHS = 50


def audit_records(operations: DataFrame) -> DataFrame:
    """Rows ready to append, from operations with optional columns.

    Of an array ``paths`` a record shows the first ones and the count of all.
    ``metadata`` is a map of texts. Without a ``description`` one is made of
    action and entity.
    """

    def given(name: str, kind: str):
        found = name in operations.columns
        return F.col(name) if found else F.lit(None).cast(kind)

    paths = given("paths", "array<string>")
    made = F.concat_ws(" ", "action", "entity_type", "entity_id")
    return operations.select(
        "log_id", "correlation_id", "action", "entity_type", "entity_id",
        F.coalesce(given("description", "string"), made).alias("description"),
        "bytes_affected", F.slice(paths, 1, SHOWN_PATHS).alias("paths_affected"),
        F.when(paths.isNull(), 0).otherwise(F.size(paths)).cast("bigint").alias("path_count"),
        given("metadata", "map<string,string>").alias("metadata"), "severity", "created_at",
    )


def query_audit(
    log: DataFrame,
    action: str | None = None,
    entity_type: str | None = None,
    entity_id: str | None = None,
    correlation_id: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    wanted = {
        "action": action, "entity_type": entity_type, "entity_id": entity_id,
        "correlation_id": correlation_id, "severity": severity,
    }
    return where_all(log, [F.col(c) == v for c, v in wanted.items() if v is not None])


def audit_order() -> list[Column]:
    return [F.col("created_at").desc(), F.col("log_id")]
