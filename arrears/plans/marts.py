"""Reporting marts (dashboard pages re-aimed as aggregates)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.functions.text import money_sum
from arrears.plans import kpi
from arrears.plans.model import Model

col = F.col
ratio = kpi.ratio
count_if = kpi._count_if


# M1
def dialer_outcomes(m: Model) -> DataFrame:
    d = col("disposition")
    return (m.fact_dialer.groupBy("call_date")
            .agg(F.count(F.lit(1)).alias("total_calls"),
                 count_if(d == "ANSWERED").alias("answered"),
                 count_if(d == "FAILED").alias("failed"),
                 count_if(d == "NO ANSWER").alias("no_answer"))
            .select("call_date", "total_calls",
                    ratio(col("answered"), col("total_calls")).alias("answered_pct"),
                    ratio(col("failed"), col("total_calls")).alias("failed_pct"),
                    ratio(col("no_answer"), col("total_calls")).alias("no_answer_pct")))


# M2
SCORE_STEP, SCORE_BUCKETS = 1 / 256, 4096


def operator_ranking(m: Model) -> DataFrame:
    """Rank of operators by quality score (ties share a rank, null last).

    Distinct scores are counted, cut into a fixed number of score buckets,
    ranked inside their bucket and moved up by the operators in higher
    buckets: only the bucket totals (at most ``SCORE_BUCKETS`` + 1 rows) are
    ever summed in one task."""
    q = m.stored({}, quality_scores=kpi.quality_score(m)).quality_scores  # read three times below
    score = col("quality_score")
    bucket = F.when(score.isNull(), -1).otherwise(
        F.greatest(F.least(F.floor(score / SCORE_STEP), F.lit(SCORE_BUCKETS - 1)), F.lit(0))).cast("int")
    scores = q.groupBy("quality_score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket)
    higher = Window.orderBy(col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = scores.groupBy("_b").agg(F.sum("_n").alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(higher), F.lit(0)).alias("_above"))
    inside = (Window.partitionBy("_b").orderBy(score.desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    ranks = (scores.withColumn("_ahead", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .join(totals, "_b")
             .select(score.alias("_s"), (col("_above") + col("_ahead") + 1).cast("int").alias("score_rank")))
    return q.join(ranks, score.eqNullSafe(col("_s"))).select("operator_id", "quality_score", "score_rank")


# M3
def paid_by_client(m: Model) -> DataFrame:
    return (m.fact_ptp_enriched.groupBy("client_id", "company_name")
            .agg(money_sum("payed_capital").alias("paid"),
                 F.count("payment_id").alias("payments")))


def weekly_pace(m: Model) -> DataFrame:
    e = m.fact_ptp_enriched.where(col("payment_date").isNotNull())
    return (e.groupBy(F.ceil(F.dayofmonth("payment_date") / 7).cast("int").alias("WeekOfMonth"))
             .agg(money_sum("payed_capital").alias("paid"), F.count(F.lit(1)).alias("payments")))


# M4
def attendance_matrix(m: Model) -> DataFrame:
    """Operator x day pivot. The day columns are the business days of the
    parameter range (listed explicitly, so Spark does not scan to find
    them); each cell is that day's status."""
    p = m.pe
    days = [p.calendar_start + dt.timedelta(days=i)
            for i in range((p.as_of - p.calendar_start).days + 1)]
    names = [d.isoformat() for d in days if d.weekday() < 5]
    return (m.fact_operator_presence
            .withColumn("_day", F.date_format("WorkDate", "yyyy-MM-dd"))
            .groupBy("users_id", "user_name").pivot("_day", names)
            .agg(F.max("attendance_status")))


# M5
def absence_by_week(m: Model) -> DataFrame:
    s = col("attendance_status")
    return (m.fact_operator_presence
            .groupBy(F.year("WorkDate").alias("Year"), F.weekofyear("WorkDate").alias("WeekNumber"))
            .agg(count_if(s == "absent").alias("absent_days"),
                 count_if(~s.isin("inactive", "not_employed")).alias("workdays"))
            .withColumn("absence_pct", ratio(col("absent_days"), col("workdays"))))


# M6
def paid_by_uf(m: Model) -> DataFrame:
    return (m.fact_ptp.groupBy("uf")
            .agg(F.count(F.lit(1)).alias("promises"),
                 count_if(col("was_paid") == "paid").alias("paid_promises"),
                 money_sum("paid").alias("paid"))
            .withColumn("was_paid_pct", ratio(col("paid_promises"), col("promises"))))


# M7
def dpd_analysis(m: Model) -> DataFrame:
    return (m.fact_ptp.groupBy("dpd_range")
            .agg(F.count(F.lit(1)).alias("promises"),
                 money_sum("promise_capital").alias("promise_capital"),
                 money_sum("paid").alias("paid")))


def portfolio(m: Model) -> DataFrame:
    return (m.dim_cases.groupBy("client_id", "provider")
            .agg(F.count(F.lit(1)).alias("cases"),
                 money_sum("actual_capital").alias("actual_capital")))


# M8
def contacts_by_hour(m: Model) -> DataFrame:
    return (m.fact_contacts.groupBy("contact_hour")
            .agg(F.count(F.lit(1)).alias("contacts"),
                 F.sum("has_promise").cast("bigint").alias("promises")))


# M9
def operator_day(m: Model) -> DataFrame:
    """Operator-day grid with activity, calls and promises. Each source is
    aggregated to (operator, day) before its left join, so every join is
    one-to-at-most-one."""
    grid = m.fact_operator_presence.select("users_id", "WorkDate", "attendance_status",
                                           "contact_count")
    calls = (m.fact_dialer.groupBy(col("operator_id").alias("_o1"), col("call_date").alias("_d1"))
             .agg(F.count(F.lit(1)).alias("calls"),
                  F.sum("answered_flag").cast("bigint").alias("answered_calls"),
                  F.sum("cpc_flag").cast("bigint").alias("cpc_calls")))
    prom = (m.fact_contacts.groupBy(col("operator_id").alias("_o2"), col("contact_date").alias("_d2"))
            .agg(F.sum("has_promise").cast("bigint").alias("promises")))
    x = (grid.join(calls, (grid["users_id"] == calls["_o1"]) & (grid["WorkDate"] == calls["_d1"]), "left")
             .join(prom, (grid["users_id"] == prom["_o2"]) & (grid["WorkDate"] == prom["_d2"]), "left"))
    return x.select("users_id", "WorkDate", "attendance_status", "contact_count",
                    F.coalesce("calls", F.lit(0)).alias("calls"),
                    F.coalesce("answered_calls", F.lit(0)).alias("answered_calls"),
                    F.coalesce("cpc_calls", F.lit(0)).alias("cpc_calls"),
                    F.coalesce("promises", F.lit(0)).alias("promises"))


# M10
def non_dialer_ptp(m: Model) -> DataFrame:
    """Promises per channel, dialer promises excluded (no double count)."""
    return (m.fact_contacts.where((col("has_promise") == 1) & (col("contact_channel") != "Dialer"))
            .groupBy("contact_channel").agg(F.count(F.lit(1)).alias("ptp_count")))
