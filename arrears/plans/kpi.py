"""KPIs over the facts (documented formulas, re-expressed as aggregates).

Pattern for ratios over two facts: aggregate each fact to the KPI key
first, union the partial rows and sum again. No fact-to-fact join, so no
fan-out, and each side's aggregation is partial on the map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears import config as C
from arrears.functions.dates import month_bounds
from arrears.functions.text import money_sum, norm
from arrears.operators.calendar import dates_between, date_table
from arrears.plans.model import Model

col = F.col


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _combine(key: str, *parts: DataFrame) -> DataFrame:
    """Union per-key partial aggregates (a measure a part lacks counts as 0)
    and sum them per key: a full outer combination without a join."""
    measures: list[str] = []
    for p in parts:
        measures += [c for c in p.columns if c != key and c not in measures]
    aligned = [p.select(key, *[(col(m) if m in p.columns else F.lit(0)).alias(m) for m in measures])
               for p in parts]
    u = aligned[0]
    for a in aligned[1:]:
        u = u.unionByName(a)
    return u.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])


# K1 -------------------------------------------------------------------
def effectivity(m: Model) -> DataFrame:
    """Paid PTP / all PTP per operator; a PTP (case, ref, promise date) is
    paid when any of its rows is PAID (the fact has a row per payment)."""
    per_ptp = (m.fact_ptp_enriched
               .groupBy("operator", "case_id", "ref_number", "promise_date")
               .agg(F.max(F.when(col("ptp_status") == "PAID", 1).otherwise(0)).alias("_paid")))
    return (per_ptp.groupBy("operator")
            .agg(F.count(F.lit(1)).alias("total_ptp"), F.sum("_paid").cast("bigint").alias("paid_ptp"))
            .withColumn("effectivity", ratio(col("paid_ptp"), col("total_ptp"))))


# K2 -------------------------------------------------------------------
def dialer_score(m: Model) -> DataFrame:
    ptp = (m.fact_contacts.where((col("has_promise") == 1) & (col("contact_channel") == "Dialer"))
           .groupBy("operator_id").agg(F.count(F.lit(1)).alias("dialer_ptp")))
    ans = m.fact_dialer.groupBy("operator_id").agg(F.sum("answered_flag").cast("bigint")
                                                   .alias("answered_calls"))
    return (_combine("operator_id", ptp, ans)
            .withColumn("dialer_score", ratio(col("dialer_ptp"), col("answered_calls"))))


# K3 -------------------------------------------------------------------
def promise_index(m: Model) -> DataFrame:
    ptp = m.fact_ptp.groupBy("operator_id").agg(F.count(F.lit(1)).alias("ptp_count"))
    cc = (m.cc_operator_activity.groupBy(col("user_id").alias("operator_id"))
          .agg(F.sum("contact_count").cast("bigint").alias("cc_contacts")))
    return (_combine("operator_id", ptp, cc)
            .withColumn("promise_index", ratio(col("ptp_count"), col("cc_contacts"))))


# K4 -------------------------------------------------------------------
def quality_score(m: Model) -> DataFrame:
    """w1 * effectivity + w2 * dialer score per operator id (a missing
    component counts as 0). The weights are parameters: the source does
    not publish them."""
    w1, w2 = m.pe.quality_weights
    users = m.src.users.select(norm("full_name").alias("_name"), col("user_id").alias("operator_id"))
    eff = effectivity(m)
    eff = (eff.join(users, norm(eff["operator"]) == users["_name"], "inner")
              .groupBy("operator_id").agg(F.sum("total_ptp").alias("total_ptp"),
                                          F.sum("paid_ptp").alias("paid_ptp")))
    ds = dialer_score(m).select("operator_id", "dialer_ptp", "answered_calls")
    x = _combine("operator_id", eff, ds)
    e = ratio(col("paid_ptp"), col("total_ptp"))
    d = ratio(col("dialer_ptp"), col("answered_calls"))
    return x.select(
        "operator_id", e.alias("effectivity"), d.alias("dialer_score"),
        (F.lit(w1) * F.coalesce(e, F.lit(0.0)) + F.lit(w2) * F.coalesce(d, F.lit(0.0)))
        .alias("quality_score"))


# K5 -------------------------------------------------------------------
def paid_per_rpc(m: Model) -> DataFrame:
    paid = m.fact_payments.groupBy("client_id").agg(money_sum("payed_capital").alias("paid"))
    rpc = m.fact_contacts.groupBy("client_id").agg(F.sum("is_rpc").cast("bigint").alias("rpc_count"))
    x = _combine("client_id", paid.select(col("client_id").cast("bigint"), "paid"),
                 rpc.select(col("client_id").cast("bigint"), "rpc_count"))
    return x.withColumn("paid_per_rpc", ratio(col("paid"), col("rpc_count")))


# K6 -------------------------------------------------------------------
def commission(m: Model) -> DataFrame:
    """Aggregate paid per client first, then join the (one row per client)
    rule table: the join sees one row per client, never per payment."""
    paid = m.fact_ptp_enriched.groupBy("client_id").agg(money_sum("payed_capital").alias("paid"))
    r = m.dim_commission_rules.withColumnRenamed("client_id", "_rc")
    return (paid.join(r, paid["client_id"] == r["_rc"], "left")
                .select("client_id", "paid", "commission_rate",
                        (col("paid") * col("commission_rate")).alias("commission_value")))


# K7 -------------------------------------------------------------------
def forecast_eom(m: Model) -> DataFrame:
    """Per day of the as-of month: cumulative paid, business days elapsed,
    business days in the month and the straight-line month-end forecast.
    The running sums run over at most 31 rows (one per day)."""
    _, m0, m1 = month_bounds(m.po.as_of)
    last = m1 - dt.timedelta(days=1)
    daily = (m.fact_payments.where((col("payment_date") >= F.lit(m0)) & (col("payment_date") < F.lit(m1)))
             .groupBy("payment_date").agg(F.sum(col("payed_capital").cast("decimal(19,4)")).alias("_p")))
    spark = m.src.spark
    days = spark.range(1).select(F.explode(dates_between(F.lit(m0), F.lit(last))).alias("Date"))
    x = days.join(F.broadcast(daily), days["Date"] == daily["payment_date"], "left")
    w = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bd = F.when(F.weekday("Date") < 5, 1).otherwise(0)
    x = (x.withColumn("daily_paid", F.coalesce(col("_p"), F.lit(0).cast("decimal(19,4)")))
          .withColumn("cum_paid", F.sum("daily_paid").over(w))
          .withColumn("workdays_elapsed", F.sum(bd).over(w).cast("bigint"))
          .withColumn("total_workdays", F.lit(_business_days(m0, last)).cast("bigint")))
    return x.select(
        "Date", col("daily_paid").cast("double").alias("daily_paid"),
        col("cum_paid").cast("double").alias("cum_paid"), "workdays_elapsed", "total_workdays",
        (ratio(col("cum_paid"), col("workdays_elapsed")) * col("total_workdays")).alias("forecast_eom"))


def _business_days(lo: dt.date, hi: dt.date) -> int:
    return sum(1 for i in range((hi - lo).days + 1) if (lo + dt.timedelta(days=i)).weekday() < 5)


# K8 / K9 ----------------------------------------------------------------
def _eligible():
    return ~col("attendance_status").isin("inactive", "not_employed")


def absence(m: Model) -> DataFrame:
    return (m.fact_operator_presence.groupBy("users_id")
            .agg(_count_if(col("attendance_status") == "absent").alias("absent_days"),
                 _count_if(_eligible()).alias("workdays"))
            .withColumn("absence_pct", ratio(col("absent_days"), col("workdays"))))


def presence(m: Model) -> DataFrame:
    return (m.fact_operator_presence.groupBy("users_id")
            .agg(_count_if(col("attendance_status").isin("present", "training")).alias("present_days"),
                 _count_if(_eligible()).alias("workdays"))
            .withColumn("presence_pct", ratio(col("present_days"), col("workdays"))))


# K10 / K11 --------------------------------------------------------------
def cpc_rate(m: Model) -> DataFrame:
    return (m.fact_dialer.groupBy("call_date")
            .agg(F.count(F.lit(1)).alias("total_calls"),
                 F.sum("cpc_flag").cast("bigint").alias("cpc_calls"))
            .withColumn("cpc_rate", ratio(col("cpc_calls"), col("total_calls"))))


def not_connected(m: Model) -> DataFrame:
    return (m.fact_dialer.groupBy("call_date")
            .agg(F.sum("answered_flag").cast("bigint").alias("answered_calls"),
                 F.sum("operator_not_connected_flag").cast("bigint").alias("not_connected_calls"))
            .withColumn("not_connected_pct", ratio(col("not_connected_calls"), col("answered_calls"))))


# K12 / K13 --------------------------------------------------------------
def recovery(m: Model) -> DataFrame:
    paid = (m.fact_payments.groupBy(col("client_id").cast("bigint").alias("client_id"))
            .agg(F.sum(col("payed_capital").cast("decimal(19,4)")).alias("paid")))
    cap = (m.dim_cases.groupBy(col("client_id").cast("bigint").alias("client_id"))
           .agg(F.sum(col("actual_capital").cast("decimal(19,4)")).alias("actual_capital")))
    x = _combine("client_id", paid, cap)
    return x.select("client_id", col("paid").cast("double").alias("paid"),
                    col("actual_capital").cast("double").alias("actual_capital"),
                    ratio(col("paid"), col("actual_capital")).alias("recovery_pct"))


def recovery_potential(m: Model) -> DataFrame:
    """Actual capital per client x the portfolio's average recovery rate.
    The portfolio rate is a scalar subquery: computed once, no join."""
    r = recovery(m)
    tot = r.agg(ratio(F.sum(col("paid").cast("decimal(38,4)")),
                      F.sum(col("actual_capital").cast("decimal(38,4)"))).alias("rate"))
    rate = tot.scalar()
    return r.select("client_id", "actual_capital", rate.alias("avg_recovery_rate"),
                    (col("actual_capital") * rate).alias("recovery_potential"))


# K14 / K15 --------------------------------------------------------------
def promise_by_cc(m: Model) -> DataFrame:
    return (m.fact_contacts.groupBy("operator_id")
            .agg(F.sum("has_promise").cast("bigint").alias("ptp_count"),
                 F.count(F.lit(1)).alias("cc_contacts"))
            .withColumn("promise_by_cc", ratio(col("ptp_count"), col("cc_contacts"))))


def high_dpd_paid(m: Model) -> DataFrame:
    paid = col("paid").cast("decimal(19,4)")
    return (m.fact_ptp.groupBy("client_id")
            .agg(F.sum(F.when(col("dpd") > C.HIGH_DPD, paid).otherwise(F.lit(0).cast("decimal(19,4)")))
                 .alias("_hi"), F.sum(paid).alias("_all"))
            .select("client_id", col("_hi").cast("double").alias("paid_high_dpd"),
                    col("_all").cast("double").alias("paid_total"),
                    ratio(col("_hi"), col("_all")).alias("high_dpd_paid_pct")))


# K16 -------------------------------------------------------------------
def paid_by_payment_date(m: Model) -> DataFrame:
    """Role-playing date: promise payments keyed by *payment* date with the
    calendar's attributes of that day."""
    daily = m.fact_ptp.groupBy("payment_date").agg(money_sum("paid").alias("paid"))
    cal = dim_date(m).select(col("Date").alias("_d"), "Year", "MonthNumber", "YearMonthKey", "WeekOfMonth")
    return (daily.join(cal, daily["payment_date"] == cal["_d"], "left")
                 .select("payment_date", "Year", "MonthNumber", "YearMonthKey", "WeekOfMonth", "paid"))


# CA1 -------------------------------------------------------------------
def dim_date(m: Model) -> DataFrame:
    """Reporting calendar: from 1 January of the earliest day of any source
    date column to a year after the latest as_of, or to the latest day if
    that is later. One aggregate row, then one generated row per day."""
    spans = None
    for relation, c in (("payments", "payment_date"), ("ptp_overview", "contact_date"),
                        ("ptp_overview", "promise_date"), ("ptp_overview", "last_payment_date"),
                        ("contact_events", "contact_date"), ("dialer_calls", "call_date")):
        part = m.src.rel(relation).agg(F.to_date(F.min(c)).alias("_lo"), F.to_date(F.max(c)).alias("_hi"))
        spans = part if spans is None else spans.unionByName(part)
    end = F.lit(max(m.pe.as_of, m.po.as_of) + dt.timedelta(days=365))
    span = spans.agg(F.min("_lo").alias("_lo"), F.greatest(F.max("_hi"), end).alias("_hi"))
    days = span.select(F.explode(dates_between(F.make_date(F.year("_lo"), F.lit(1), F.lit(1)),
                                               col("_hi"))).alias("Date"))
    return date_table(days)
