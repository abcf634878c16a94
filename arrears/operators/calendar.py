"""Calendars: date lists, business days and the reporting date table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dates_between(start: Column, end: Column) -> Column:
    """Array of every date from ``start`` to ``end`` (both included)."""
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def explode_workdays(df: DataFrame, start: dt.date, end: dt.date, out: str = "WorkDate") -> DataFrame:
    """One row per input row and business day (Mon-Fri) in [start, end].

    A generator on each row instead of a join with a calendar table: the
    output is the operator x day grid itself, produced where the operator
    row lives, with no shuffle and nothing broadcast.
    """
    days = F.filter(dates_between(F.lit(start), F.lit(end)), lambda d: F.weekday(d) < 5)
    return df.withColumn(out, F.explode(days))


def date_table(days: DataFrame, col: str = "Date") -> DataFrame:
    """Reporting calendar attributes for a DataFrame with one date column.

    WeekOfMonth is the 7-day block of the month (days 1-7 -> 1, ..., 29-31
    -> 5); WeekOfMonthKey is that block's first day.
    """
    d = F.col(col)
    wom = F.ceil(F.dayofmonth(d) / 7).cast("int")
    return days.select(
        d.alias("Date"),
        F.year(d).alias("Year"),
        F.month(d).alias("MonthNumber"),
        F.quarter(d).alias("Quarter"),
        F.date_format(d, "yyyy-MM").alias("MonthYear"),
        (F.year(d) * 100 + F.month(d)).alias("YearMonthKey"),
        (F.weekday(d) + 1).alias("WeekDayNumber"),
        (F.weekday(d) >= 5).alias("IsWeekend"),
        F.lit(False).alias("IsHoliday"),
        (F.weekday(d) < 5).alias("IsBusinessDay"),
        F.weekofyear(d).alias("WeekNumber"),
        wom.alias("WeekOfMonth"),
        F.concat(F.date_format(d, "MMM"), F.lit(" W"), wom.cast("string")).alias("WeekOfMonthLabel"),
        F.make_date(F.year(d), F.month(d), (wom - 1) * 7 + 1).alias("WeekOfMonthKey"),
    )
