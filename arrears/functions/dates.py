"""Date helpers. Bounds derived from ``as_of`` are computed on the driver
as plain literals so Catalyst folds them and pushes them to the scan."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date, dt.date]:
    """(first day of previous month, first day of month, first day of next)."""
    m0 = month_start(as_of)
    return add_months(m0, -1), m0, add_months(m0, 1)


def rolling_start(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)


def year_start_prev(as_of: dt.date) -> dt.date:
    """1 January of the year before ``as_of``."""
    return dt.date(as_of.year - 1, 1, 1)


def seconds_of_day(hms: Column) -> Column:
    """Seconds since midnight of an ``HH:mm:ss`` string (null if malformed)."""
    parts = F.split(hms, ":")
    h = parts.getItem(0).try_cast("int")
    m = parts.getItem(1).try_cast("int")
    s = parts.getItem(2).try_cast("int")
    return h * 3600 + m * 60 + s


def at_time(day: Column, hms: Column) -> Column:
    """Timestamp of ``day`` plus an ``HH:mm:ss`` time of day."""
    return F.timestamp_add("SECOND", seconds_of_day(hms), day.cast("timestamp_ntz"))
