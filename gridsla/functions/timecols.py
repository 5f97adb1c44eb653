"""Time expressions on TIMESTAMP_NTZ columns that never pass through a time zone.

``date_trunc`` returns a zoned TIMESTAMP; casting it back depends on the session
time zone (and breaks on DST gaps). These helpers stay zone-free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_second(ts: Column) -> Column:
    """Drop the sub-second part of a TIMESTAMP_NTZ (PostgreSQL date_trunc('second', ts))."""
    fraction = F.date_part(F.lit("SECOND"), ts) - F.second(ts)  # decimal seconds in [0, 1)
    return ts - F.make_dt_interval(secs=fraction)


def plus_minutes(ts: Column, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_add("MINUTE", minutes, ts)


def micros_between(start: Column, end: Column) -> Column:
    """(end - start) in whole microseconds as bigint; NULL if either is NULL.

    The NTZ difference is a day-time interval (wall clock, no zone);
    ``timestampdiff`` would pass both values through the session time zone and
    go wrong across a DST change.
    """
    seconds = (end - start).cast("interval second").cast("decimal(24,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def minutes_between(start: Column, end: Column) -> Column:
    """(end - start) in minutes as double; NULL if either is NULL."""
    return micros_between(start, end) / F.lit(60_000_000.0)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def day_start(ts: Column) -> Column:
    """Midnight of the day of ``ts`` as TIMESTAMP_NTZ (the ``job_day`` batch key)."""
    return F.to_date(ts).cast("timestamp_ntz")
