"""Presentation orderings of the datasets (the source's ORDER BY clauses).

A global sort is a range-partitioned shuffle of the whole dataset, so the
datasets themselves stay unsorted; these views are for consumers that need
the ordered listing (exports, paged reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.plans.model import Model

col = F.col


def dialer_listing(m: Model) -> DataFrame:
    """Calls, newest first (ties by call id for a stable order)."""
    return m.fact_dialer.orderBy(col("call_datetime").desc_nulls_last(), col("dialer_call_id").desc())


def ptp_listing(m: Model) -> DataFrame:
    """Promises and payments by ref, then payment date (unpaid rows first)."""
    return m.fact_ptp_enriched.orderBy(col("ref_number").asc_nulls_first(),
                                       col("payment_date").asc_nulls_first(),
                                       col("payment_id").asc_nulls_first())


def presence_listing(m: Model) -> DataFrame:
    """Attendance, latest work day first, then operator name."""
    return m.fact_operator_presence.orderBy(col("WorkDate").desc(), col("full_name").asc_nulls_first(),
                                            col("users_id").asc())
