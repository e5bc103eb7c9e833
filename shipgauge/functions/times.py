"""Timestamp parsing and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted timestamp layouts. RFC 3339 with or without a fraction,
# and milliseconds followed by an offset without a colon.
TRACKER_TIME = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
    r"((\.\d+)?(Z|[+-]\d{2}:\d{2})|\.\d{3}[+-]\d{4})$"
)
TASK_DATE = r"^\d{4}-\d{2}-\d{2}$"

MICROS_PER_HOUR = 3_600_000_000


def _cast_if(col: Column, pattern: str) -> Column:
    """One pattern check and Spark's own cast; cheaper than trying formatters
    in turn, each of which fails by throwing."""
    return F.when(col.rlike(pattern), col.try_cast("timestamp"))


def parse_tracker_time(col: Column) -> Column:
    """Timestamp in any accepted layout; NULL where none fits."""
    return _cast_if(col, TRACKER_TIME)


def parse_task_date(col: Column) -> Column:
    return _cast_if(col, TASK_DATE)


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours at microsecond resolution; may be negative."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(float(MICROS_PER_HOUR))


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{int(days)}' DAY")


def target_date(as_of: Column, days: Column) -> Column:
    """Calendar day reached after the whole days of ``days``."""
    return F.date_add(F.to_date(as_of), days.cast("int"))
