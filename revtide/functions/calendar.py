"""Calendar expressions. Timestamps are UTC; ``tz`` picks the display zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Week starts on Sunday.
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def local_ts(ts: Column | str, tz: str = "UTC") -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return c if tz == "UTC" else F.from_utc_timestamp(c, tz)


def local_day(ts: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(local_ts(ts, tz))


def weekday_index(ts: Column | str, tz: str = "UTC") -> Column:
    """0 = Sunday."""
    return F.dayofweek(local_ts(ts, tz)) - 1


def weekday_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (index + 1).cast("int"))


def months_before(day: Column, n: int) -> Column:
    """Same day of month ``n`` months earlier; a missing day runs into the next month."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -n), F.dayofmonth(day) - 1)


def epoch_to_timestamp(seconds: Column | str) -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.timestamp_seconds(c)
