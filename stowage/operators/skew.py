"""A lookup join that splits hot keys.

Several operators look up one row per key (a size, a hash, a group) for many
rows. If one key holds a large part of the rows, a plain shuffle join sends
them all to one task. Here the heaviest keys are spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a key up to which one task can hold it. All keys beyond are hot; there is
# at most one for each so many rows, so even of 10^12 rows their list has 2 million.
ROWS_PER_TASK = 500_000


def join_by_key(
    rows: DataFrame,
    lookup: DataFrame,
    key: str | list[str],
    weight: str,
    spread_by: str,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Joins ``rows`` with the one ``lookup`` row per ``key``, one column or several.

    ``lookup.weight`` is the number of rows of that key. Each hot key is cut
    into as many pieces as its rows ask for, by a hash of ``spread_by``, and its
    lookup row is repeated once per piece; all other keys have one piece.
    Nothing is dropped.
    """
    keys = [key] if isinstance(key, str) else key
    pieces = F.when(
        F.col(weight) > rows_per_task, F.ceil(F.col(weight) / rows_per_task).cast("int")
    ).otherwise(1)
    hot = F.broadcast(lookup.where(F.col(weight) > rows_per_task).select(*keys, pieces.alias("_pieces")))
    left = rows.join(hot, keys, "left").withColumn(
        "_piece",
        F.when(
            F.col("_pieces").isNotNull(),
            F.pmod(F.xxhash64(F.col(spread_by)), F.col("_pieces")).cast("int"),
        ).otherwise(0),
    ).drop("_pieces")
    right = lookup.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right, [*keys, "_piece"], how).drop("_piece")
