"""Event-time helpers. Event time has no zone: TIMESTAMP_NTZ plus its epoch second."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ORIGIN = "timestamp_ntz'1970-01-01 00:00:00'"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def epoch_of(ts: Column) -> Column:
    """Whole seconds since 1970, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.expr(ORIGIN), ts.cast("timestamp_ntz"))


def floor_epoch(ts: Column) -> Column:
    """The same, counted down to the whole second before. From 1970 on it is plain arithmetic, without a calendar."""
    whole = F.unix_timestamp(ts.cast("timestamp_ntz"))     # towards zero
    return F.when(whole > 0, whole).otherwise(
        epoch_of(F.date_trunc("second", ts.cast("timestamp")).cast("timestamp_ntz")))


def ts_of(epoch: Column) -> Column:
    return F.timestamp_add("SECOND", epoch, F.expr(ORIGIN))


def iso(epoch: Column) -> Column:
    return F.date_format(ts_of(epoch), ISO)


def parse(text: Column, pattern: str) -> Column:
    """Tolerant parse; NULL where the text does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    return parse(F.trim(text), ISO)


def in_range(ts: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Closed range with open ends; a NULL time is outside, a NULL bound is open."""
    inside = ts.isNotNull()
    if start is not None:
        inside = inside & F.coalesce(ts >= start, F.lit(True))
    if end is not None:
        inside = inside & F.coalesce(ts <= end, F.lit(True))
    return inside


def floor_to(epoch: Column, seconds: int) -> Column:
    return epoch - F.pmod(epoch, F.lit(seconds)) if seconds > 0 else epoch


def day_start(as_of: Column) -> Column:
    return F.date_trunc("day", as_of).cast("timestamp_ntz")


def days_before(as_of: Column, days: float) -> Column:
    return F.timestamp_add("SECOND", F.lit(-int(days * 86400)), as_of)
