"""Registered queries: name -> (Spark builder, oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` through the adapters and returns a lazy DataFrame. Column names
are identical to the oracle's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrears.checks import oracle as Q
from arrears.sources.driver_dates import EVENTS_AS_OF, events_params, orders_params
from arrears.plans import dims, facts
from arrears.sources.catalog import DriverSources

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def ev(fn, **kw) -> Builder:
    return lambda spark, d: fn(DriverSources(spark, d), events_params(**kw))


def od(fn, **kw) -> Builder:
    return lambda spark, d: fn(DriverSources(spark, d), orders_params(**kw))


def add(name: str, builder: Builder, sql: str | None) -> None:
    REGISTRY[name] = (builder, sql)


# ---- datasets (DS1-DS11)
add("fact_dialer", ev(facts.fact_dialer), Q.table("fact_dialer"))
add("fact_contacts", ev(facts.fact_contacts), Q.table("fact_contacts"))
add("fact_ptp", od(facts.fact_ptp), Q.table("fact_ptp"))
add("fact_ptp_enriched", od(facts.fact_ptp_enriched), Q.table("fact_ptp_enriched"))
add("fact_payments", od(facts.fact_payments), Q.table("fact_payments"))
add("cc_operator_activity", ev(facts.cc_operator_activity), Q.table("cc_operator_activity"))
add("fact_operator_presence", ev(facts.fact_operator_presence), Q.table("fact_operator_presence"))
add("dim_operators", ev(facts.dim_operators), Q.table("dim_operators"))
add("dim_cases", od(dims.dim_cases), Q.table("dim_cases"))
add("dim_client", od(dims.dim_client), Q.table("dim_client"))
add("dim_company", od(dims.dim_company), Q.table("dim_company"))

# Variants: a look-back bound that cuts inside the events' month, and the source's plain provider join.
EVENTS_CUT_AS_OF = EVENTS_AS_OF + dt.timedelta(days=45)
add("rolling_60d_cut", ev(facts.contact_base, as_of=EVENTS_CUT_AS_OF),
    Q.table("recent_contacts").replace(EVENTS_AS_OF.isoformat(), EVENTS_CUT_AS_OF.isoformat()))
add("fact_ptp_plain_provider", od(facts.fact_ptp, provider_mode="join"), Q.table("fact_ptp_plain_provider"))
add("dim_cases_plain_provider", od(dims.dim_cases, provider_mode="join"), Q.table("dim_cases_plain_provider"))

# The documented rules where the source's code differs from them.
for _name, _fn, _b, _kw in [
    ("dim_operators", facts.dim_operators, ev, {"strict_sip": True}),
    ("fact_operator_presence", facts.fact_operator_presence, ev, {"strict_sip": True, "require_inactive_status": True}),
    ("fact_ptp_enriched", facts.fact_ptp_enriched, od, {"old_money_window": "30d"}),
]:
    add(f"{_name}_documented", _b(_fn, **_kw), Q.table(f"{_name}_documented"))

# ---- everything else reads the shared model
from arrears.checks import oracle_reports as R  # noqa: E402,F401  (registers CTEs)
from arrears.plans import cube, kpi, marts, quality, stored, views  # noqa: E402
from arrears.plans.model import Model  # noqa: E402


def mdl(fn) -> Builder:
    return lambda spark, d: fn(Model(DriverSources(spark, d), events_params(), orders_params()))


add("dim_date", mdl(kpi.dim_date), Q.table("dim_date"))
add("dim_commission_rules", od(dims.dim_commission_rules), Q.table("dim_commission_rules_v"))

# name -> (function of a Model, oracle CTE name): reports over the model.
MODEL_REPORTS: dict = {}

for _name, _fn in [
    ("kpi_effectivity", kpi.effectivity), ("kpi_dialer_score", kpi.dialer_score),
    ("kpi_promise_index", kpi.promise_index), ("kpi_quality_score", kpi.quality_score),
    ("kpi_paid_per_rpc", kpi.paid_per_rpc), ("kpi_commission", kpi.commission),
    ("kpi_forecast_eom", kpi.forecast_eom), ("kpi_absence", kpi.absence),
    ("kpi_presence", kpi.presence), ("kpi_cpc_rate", kpi.cpc_rate),
    ("kpi_not_connected", kpi.not_connected), ("kpi_recovery", kpi.recovery),
    ("kpi_recovery_potential", kpi.recovery_potential), ("kpi_promise_by_cc", kpi.promise_by_cc),
    ("kpi_high_dpd_paid", kpi.high_dpd_paid), ("kpi_paid_by_payment_date", kpi.paid_by_payment_date),
    ("mart_dialer_outcomes", marts.dialer_outcomes), ("mart_operator_ranking", marts.operator_ranking),
    ("mart_paid_by_client", marts.paid_by_client), ("mart_weekly_pace", marts.weekly_pace),
    ("mart_attendance_matrix", marts.attendance_matrix),
    ("mart_absence_by_week", marts.absence_by_week), ("mart_paid_by_uf", marts.paid_by_uf),
    ("mart_dpd_analysis", marts.dpd_analysis), ("mart_portfolio", marts.portfolio),
    ("mart_contacts_by_hour", marts.contacts_by_hour), ("mart_operator_day", marts.operator_day),
    ("mart_non_dialer_ptp", marts.non_dialer_ptp),
    ("dq_primary_keys", quality.primary_keys), ("dq_foreign_keys", quality.foreign_keys),
    ("dq_fanout", quality.fanout), ("dq_value_domains", quality.value_domains),
    ("dq_flag_implications", quality.flag_implications),
    ("dq_debtor_cases", quality.debtor_many_cases),
    ("dq_presence_completeness", quality.presence_completeness),
    ("dq_client_ids", quality.client_ids),
    ("kpi_cube", cube.kpi_cube), ("dq_fanout_plain", quality.fanout_plain),
    ("dq_documented_keys", quality.documented_keys), ("dq_source_domains", quality.source_domains),
    ("dq_cross_implications", quality.cross_implications), ("dq_debtor_fanout", quality.debtor_fanout),
    ("dq_presence_gaps", quality.presence_gaps_planted), ("stored_calls_of_week", stored.calls_of_week),
]:
    MODEL_REPORTS[_name] = (_fn, _name)

MODEL_REPORTS["star_join"] = (views.star_join, "view_star_join")
MODEL_REPORTS["role_date"] = (views.role_date, "view_role_date")
MODEL_REPORTS["dialer_state"] = (views.dialer_state, "view_dialer_state")
MODEL_REPORTS["dialer_state_bot"] = (views.dialer_state_bot, "view_dialer_state_bot")
for _name, (_fn, _cte) in MODEL_REPORTS.items():
    add(_name, mdl(_fn), Q.table(_cte))

for _name, _fn, _b in [
    ("scan_inventory", views.scan_inventory, od), ("rolling_60d", facts.contact_base, ev),
    ("month_window", views.month_window, od), ("not_in_null", views.not_in_null, od),
    ("eav_303", views.eav_303, od), ("try_cast_sip", views.try_cast_sip, ev),
    ("bronze_landing", views.bronze_landing, od), ("interval_join_15m", views.interval_join_15m, ev),
    ("interval_latest", views.interval_latest, ev), ("join_norm_name", views.join_norm_name, od),
    ("join_two_hop", views.join_two_hop, od), ("exists_prev_payment", views.exists_prev_payment, od),
    ("exists_prev_month", views.exists_prev_month, od), ("anti_unpaid", views.anti_unpaid, od),
    ("cross_presence", views.cross_presence, ev), ("agg_max_time", facts.contact_time, od),
    ("agg_min_time", facts.installment_time, od), ("agg_promise_sum", facts.promise_base, od),
    ("agg_provider_max", lambda s, p: facts.attribute_max(s.case_attributes, 303), od),
    ("agg_cc", views.agg_cc, ev), ("dedup_contact_ptp", views.dedup_contact_ptp, ev),
    ("dedup_bridge", views.dedup_bridge, ev), ("dedup_ptp_month", views.dedup_ptp_month, od),
    ("union_paid_unpaid", views.union_paid_unpaid, od), ("typed_users_load", views.typed_users_load, ev),
    ("try_cast_sip_number", views.try_cast_sip_number, ev),
]:
    _sql_name = {"rolling_60d": "recent_contacts", "agg_max_time": "promise_clock",
                 "agg_min_time": "installment_clock", "agg_promise_sum": "promise_totals",
                 "agg_provider_max": "case_provider",
                 "union_paid_unpaid": "month_money"}.get(_name, "view_" + _name)
    add(_name, _b(_fn), Q.table(_sql_name))

add("fact_payments_bucketed", od(stored.fact_payments_bucketed), Q.table("fact_payments"))
add("dim_cases_bucketed", od(stored.dim_cases_bucketed), Q.table("dim_cases"))

from arrears.plans import upkeep  # noqa: E402
from arrears.sources import profile  # noqa: E402
from arrears.streaming import match  # noqa: E402

add("fact_ptp_upkept", od(upkeep.fact_ptp_upkept), Q.table("fact_ptp"))
add("profile_report", od(profile.profile_report), Q.table("view_profile_report"))
add("interval_latest_stream", ev(match.interval_latest_stream), Q.table("view_interval_latest"))
add("calls_once_stream", ev(match.calls_once_stream), Q.table("view_calls_once"))

from arrears.plans import reports  # noqa: E402

add("sorted_fact_dialer", mdl(reports.dialer_listing), Q.table("sorted_fact_dialer"))
add("sorted_fact_ptp_enriched", mdl(reports.ptp_listing), Q.table("sorted_fact_ptp_enriched"))
add("sorted_fact_operator_presence", mdl(reports.presence_listing),
    Q.table("sorted_fact_operator_presence"))
