"""Ownership and permission expressions."""

from pyspark.sql import Column, functions as F


def octal_permissions(mode: Column) -> Column:
    """The last three octal digits of a numeric mode."""
    return F.right(F.conv(mode.cast("string"), 10, 8), F.lit(3))


def owner_or_uid(owner: Column, uid: Column) -> Column:
    """The owner's name, or the numeric id as text where no name is known."""
    return F.coalesce(owner, uid.cast("string"))
