"""KPIs in any filter context: one cube over client, operator and week.

Every fact is read once and added up to (client, operator, week) as additive numerator and
denominator states; the union of these sums is then added up over every subset of the three
(grouping sets), and the ratios are taken last. A fact that lacks a dimension stands in that
dimension's blank member. ``level`` tells which dimensions a row is a total over: 4 client,
2 operator, 1 week, added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears import config as C
from arrears.functions.text import norm
from arrears.plans.kpi import _count_if, _eligible, ratio
from arrears.plans.model import Model

col = F.col
DIMS = ("client_id", "operator_id", "week")
COUNTS = ("total_calls", "answered_calls", "cpc_calls", "not_connected_calls", "contacts", "promises", "dialer_ptp",
          "rpc_count", "ptp_count", "total_ptp", "paid_ptp", "cc_contacts", "absent_days", "present_days", "workdays")
MONEY = ("paid", "paid_promised", "paid_high_dpd", "enriched_paid", "commission", "actual_capital")
#: KPI -> (numerator, denominator) states.
RATIOS = {
    "effectivity": ("paid_ptp", "total_ptp"), "dialer_score": ("dialer_ptp", "answered_calls"),
    "promise_index": ("ptp_count", "cc_contacts"), "paid_per_rpc": ("paid", "rpc_count"),
    "absence_pct": ("absent_days", "workdays"), "presence_pct": ("present_days", "workdays"),
    "cpc_rate": ("cpc_calls", "total_calls"), "not_connected_pct": ("not_connected_calls", "answered_calls"),
    "recovery_pct": ("paid", "actual_capital"), "promise_by_cc": ("promises", "contacts"),
    "high_dpd_paid_pct": ("paid_high_dpd", "paid_promised"),
}


def _money(c: Column) -> Column:
    return F.sum(c.cast("decimal(19,4)")).cast("decimal(38,8)")


def _states(df: DataFrame, client: Column | None, operator: Column | None, day: Column | None, **aggs: Column) -> DataFrame:
    keys = [(F.lit(None) if k is None else k).cast("bigint").alias(n) for k, n in ((client, "client_id"), (operator, "operator_id"))]
    week = F.lit(None).cast("date") if day is None else F.trunc(day, "week")
    return df.groupBy(*keys, week.alias("week")).agg(*[x.alias(n) for n, x in aggs.items()])


def kpi_states(m: Model) -> DataFrame:
    """(client, operator, week) sums of every state, one pass over each fact; a state that a
    fact does not give is null."""
    one, client, seat = F.count(F.lit(1)), col("client_id"), col("operator_id")
    total = lambda c: F.sum(c).cast("bigint")
    names = m.src.users.select(norm("full_name").alias("_name"), col("user_id").alias("operator_id"))
    per_ptp = m.fact_ptp_enriched.groupBy("client_id", "operator", "case_id", "ref_number", "promise_date").agg(
        F.max(F.when(col("ptp_status") == "PAID", 1).otherwise(0)).alias("_paid"),
        _money(col("payed_capital")).alias("_money"))
    rules = m.dim_commission_rules.select(col("client_id").alias("_rc"), col("commission_rate").cast("decimal(9,4)").alias("_rate"))
    promised = per_ptp.join(names, norm(per_ptp["operator"]) == names["_name"], "left").join(
        rules, per_ptp["client_id"] == rules["_rc"], "left")
    status, high = col("attendance_status"), col("dpd") > C.HIGH_DPD
    parts = [
        _states(m.fact_dialer, client, seat, col("call_date"), total_calls=one, answered_calls=total("answered_flag"),
                cpc_calls=total("cpc_flag"), not_connected_calls=total("operator_not_connected_flag")),
        _states(m.fact_contacts, client, seat, col("contact_date"), contacts=one, promises=total("has_promise"),
                dialer_ptp=_count_if((col("has_promise") == 1) & (col("contact_channel") == "Dialer")), rpc_count=total("is_rpc")),
        _states(m.fact_ptp, client, seat, col("contact_date"), ptp_count=one, paid_promised=_money(col("paid")),
                paid_high_dpd=_money(F.when(high, col("paid")).otherwise(F.lit(0)))),
        _states(promised, client, seat, col("promise_date"), total_ptp=one, paid_ptp=total("_paid"),
                enriched_paid=F.sum("_money").cast("decimal(38,8)"),
                commission=F.sum(col("_money").cast("decimal(24,4)") * col("_rate")).cast("decimal(38,8)")),
        _states(m.fact_payments, client, None, col("payment_date"), paid=_money(col("payed_capital"))),
        _states(m.cc_operator_activity, None, col("user_id"), col("contact_date"), cc_contacts=total("contact_count")),
        _states(m.fact_operator_presence, None, col("users_id"), col("WorkDate"), absent_days=_count_if(status == "absent"),
                present_days=_count_if(status.isin("present", "training")), workdays=_count_if(_eligible())),
        _states(m.dim_cases, client, None, None, actual_capital=_money(col("actual_capital"))),
    ]
    kinds = {**dict.fromkeys(COUNTS, "bigint"), **dict.fromkeys(MONEY, "decimal(38,8)")}
    out = None
    for p in parts:
        p = p.select(*DIMS, *[(col(s) if s in p.columns else F.lit(None)).cast(t).alias(s) for s, t in kinds.items()])
        out = p if out is None else out.unionByName(p)
    return out.groupBy(*DIMS).agg(*[F.sum(s).cast(t).alias(s) for s, t in kinds.items()])


def kpi_cube(m: Model) -> DataFrame:
    """Every KPI for each client, operator and week, each pair of these, each one, and all."""
    cells = kpi_states(m).cube(*DIMS).agg(
        F.grouping_id().cast("int").alias("level"), *[F.sum(s).cast("bigint").alias(s) for s in COUNTS],
        *[F.sum(s).cast("decimal(38,8)").alias(s) for s in MONEY])
    return cells.select("level", *DIMS, *COUNTS, *[col(s).cast("double").alias(s) for s in MONEY],
                        *[ratio(col(n), col(d)).alias(k) for k, (n, d) in RATIOS.items()])
