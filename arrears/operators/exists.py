"""Existence tests written as joins (EXISTS / NOT EXISTS as values)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keys_with_rows(df: DataFrame, key: str, date_col: str, lo: dt.date, hi: dt.date) -> DataFrame:
    """Distinct ``key`` values having a row with ``lo <= date_col < hi``.

    The aggregate is partial on the map side, so a hot key ships one row
    per task, and the result has at most one row per key (no join fan-out).
    """
    return (df.where((F.col(date_col) >= F.lit(lo)) & (F.col(date_col) < F.lit(hi)))
              .where(F.col(key).isNotNull())
              .groupBy(key).agg(F.lit(1).alias("__hit")))


def flag_if_exists(df: DataFrame, keys: DataFrame, key: str, out: str) -> DataFrame:
    """``CASE WHEN EXISTS (same key in keys) THEN 1 ELSE 0 END`` as column ``out``."""
    k = keys.select(F.col(key).alias("__k"), "__hit")
    return (df.join(k, df[key] == k["__k"], "left")
              .withColumn(out, F.coalesce(F.col("__hit"), F.lit(0)))
              .drop("__k", "__hit"))


def without_match(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``NOT EXISTS (same key in keys)`` as a left anti join."""
    k = keys.select(F.col(key).alias("__k"))
    return df.join(k, df[key] == k["__k"], "left_anti")


def earlier_in_window(events: DataFrame, key: str, date_col: str,
                      window_start: Column) -> DataFrame:
    """For each distinct ``(key, date)`` of ``events``: 1 when the same key
    has a row with an earlier date that is ``>= window_start`` (a Column of
    ``date_col``, e.g. first day of the previous month), else 0.

    Rows are first reduced to distinct (key, date) pairs, so a key's window
    group holds at most one row per day of the (already date-filtered)
    history, however many rows the key has. The previous distinct date is
    the latest strictly earlier one, so the test is one ``lag``.
    """
    days = (events.where(F.col(key).isNotNull() & F.col(date_col).isNotNull())
                  .groupBy(key, date_col).agg(F.lit(1).alias("__one")).drop("__one"))
    prev = F.lag(date_col).over(Window.partitionBy(key).orderBy(date_col))
    return (days.withColumn("__prev", prev)
                .withColumn("has_previous_payment",
                            F.when(F.col("__prev") >= window_start, 1).otherwise(0))
                .drop("__prev"))
