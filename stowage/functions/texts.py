"""Display text. Digits come from whole-number arithmetic, so they are exact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.fixed_values import GIB, KIB, MIB

TIB = 1024 * GIB


def _one_decimal(size: str, unit: int, label: str) -> str:
    """``size / unit`` with one decimal, a tie going to the even digit."""
    whole, rest = f"({size}) div {unit} * 10", f"({size}) % {unit} * 10"
    tenths = f"({whole} + ({rest}) div {unit})"
    left = f"(({rest}) % {unit} * 2)"
    up = f"if({left} > {unit} OR ({left} = {unit} AND {tenths} % 2 = 1), 1, 0)"
    rounded = f"({tenths} + {up})"
    return f"concat({rounded} div 10, '.', {rounded} % 10, ' {label}')"


def human_bytes_sql(size: str, with_terabytes: bool = False) -> str:
    """SQL for a whole number of bytes as text in B, KB, MB or GB (TB on request)."""
    steps = [(GIB, "GB"), (MIB, "MB"), (KIB, "KB")]
    if with_terabytes:
        steps.insert(0, (TIB, "TB"))
    arms = " ".join(
        f"WHEN ({size}) >= {unit} THEN {_one_decimal(size, unit, label)}" for unit, label in steps
    )
    return f"CASE {arms} ELSE concat({size}, ' B') END"


def human_bytes(size: str, with_terabytes: bool = False) -> Column:
    """Text of the bytes in the named column (or SQL expression)."""
    return F.expr(human_bytes_sql(f"CAST({size} AS BIGINT)", with_terabytes))


def percent_of(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 if there is no total."""
    return F.when(total == 0, 0.0).otherwise(F.round(part / total * 100, 1))


def percent_text(part: Column, total: Column) -> Column:
    share = percent_of(part, total)
    return F.when(total == 0, "0%").otherwise(
        F.concat(share.cast("decimal(20,1)").cast("string"), F.lit("%"))
    )
