"""Time expressions. The present is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.fixed_values import UNKNOWN_AGE_DAYS

# Fixed value: the text form of a stored time.
ISO_UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

MICROS_PER_DAY = 86_400_000_000


def as_of_column(as_of: str | Column) -> Column:
    """``as_of`` as a timestamp; text is read in the session's zone."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; 0 means that the time is not known."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_UTC_FORMAT)


def parse_iso(text: Column) -> Column:
    """Stored text to a timestamp; NULL if it is no time or names no zone."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def days_since(ts: Column, as_of: str | Column) -> Column:
    """Days as a fraction, at least 0; an unknown time counts as very old."""
    elapsed = F.unix_micros(as_of_column(as_of)) - F.unix_micros(ts)
    days = F.greatest(F.lit(0.0), elapsed / F.lit(float(MICROS_PER_DAY)))
    # greatest() passes over NULL, so an unknown time needs its own branch.
    return F.when(ts.isNull(), UNKNOWN_AGE_DAYS).otherwise(days)


def whole_days_since(ts: Column, as_of: str | Column) -> Column:
    """Days rounded down (also below zero), NULL for an unknown time."""
    elapsed = F.unix_micros(as_of_column(as_of)) - F.unix_micros(ts)
    return F.floor(elapsed / F.lit(float(MICROS_PER_DAY))).cast("int")
