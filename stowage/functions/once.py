"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns that later expressions use many times.

    The optimizer moves filters below projections by writing the projected
    expression out at each use. A long chain of tests on a derived path would
    then derive the path anew for each test. A generator of exactly one row
    stops that, and stays within generated code.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
