"""Time arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000


def micros(time: Column) -> Column:
    """Microseconds between 1970-01-01 00:00:00 and the wall-clock value of ``time``; null for null."""
    days = F.unix_date(F.to_date(time))
    seconds = days.cast("bigint") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * MICROS_PER_SECOND + F.floor(F.extract(F.lit("SECOND"), time) * MICROS_PER_SECOND).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds, as a double."""
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_SECOND))


def instant(at: Column) -> Column:
    """The wall-clock time of so many microseconds after 1970-01-01 00:00:00."""
    seconds = (at / F.lit(MICROS_PER_SECOND)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
