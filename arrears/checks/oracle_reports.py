"""Oracle SQL for KPIs, marts, quality reports and operator-level views.
Registers further CTEs in the same registry as ``oracle``."""

from __future__ import annotations

import datetime as dt

from arrears import config as C
from arrears.sources import driver_dates as D
from arrears.checks.oracle import E, O, S, cte, sql, table, whole_number  # noqa: F401
from arrears.functions.dates import month_bounds

_PM, _M0, _M1 = (d.isoformat() for d in month_bounds(D.ORDERS_AS_OF))
_LAST = (month_bounds(D.ORDERS_AS_OF)[2] - dt.timedelta(days=1)).isoformat()


def _ratio(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0)"


def _money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(19, 4))) AS DOUBLE)"


# ----------------------------------------------------------------- KPIs
cte("kpi_effectivity", ("fact_ptp_enriched",), f"""
SELECT operator, COUNT(*) AS total_ptp, CAST(SUM(paid) AS BIGINT) AS paid_ptp,
       {_ratio('SUM(paid)', 'COUNT(*)')} AS effectivity
FROM (SELECT operator, case_id, ref_number, promise_date,
             MAX(CASE WHEN ptp_status = 'PAID' THEN 1 ELSE 0 END) AS paid
      FROM fact_ptp_enriched GROUP BY operator, case_id, ref_number, promise_date) t
GROUP BY operator""")

cte("kpi_dialer_score", ("fact_contacts", "fact_dialer"), f"""
SELECT operator_id, CAST(SUM(dialer_ptp) AS BIGINT) AS dialer_ptp,
       CAST(SUM(answered_calls) AS BIGINT) AS answered_calls,
       {_ratio('SUM(dialer_ptp)', 'SUM(answered_calls)')} AS dialer_score
FROM (SELECT operator_id, COUNT(*) AS dialer_ptp, 0 AS answered_calls FROM fact_contacts
      WHERE has_promise = 1 AND contact_channel = 'Dialer' GROUP BY operator_id
      UNION ALL
      SELECT operator_id, 0, SUM(answered_flag) FROM fact_dialer GROUP BY operator_id) u
GROUP BY operator_id""")

cte("kpi_promise_index", ("fact_ptp", "cc_operator_activity"), f"""
SELECT operator_id, CAST(SUM(ptp_count) AS BIGINT) AS ptp_count,
       CAST(SUM(cc_contacts) AS BIGINT) AS cc_contacts,
       {_ratio('SUM(ptp_count)', 'SUM(cc_contacts)')} AS promise_index
FROM (SELECT operator_id, COUNT(*) AS ptp_count, 0 AS cc_contacts FROM fact_ptp GROUP BY operator_id
      UNION ALL
      SELECT user_id, 0, SUM(contact_count) FROM cc_operator_activity GROUP BY user_id) u
GROUP BY operator_id""")

cte("kpi_quality_score", ("kpi_effectivity", "kpi_dialer_score", "users"), f"""
SELECT operator_id, effectivity, dialer_score,
       {C.QUALITY_WEIGHTS[0]} * COALESCE(effectivity, 0)
         + {C.QUALITY_WEIGHTS[1]} * COALESCE(dialer_score, 0) AS quality_score
FROM (SELECT operator_id, {_ratio('SUM(paid_ptp)', 'SUM(total_ptp)')} AS effectivity,
             {_ratio('SUM(dialer_ptp)', 'SUM(answered_calls)')} AS dialer_score
      FROM (SELECT u.user_id AS operator_id, e.total_ptp, e.paid_ptp, 0 AS dialer_ptp,
                   0 AS answered_calls
            FROM kpi_effectivity e JOIN users u ON LOWER(TRIM(u.full_name)) = LOWER(TRIM(e.operator))
            UNION ALL
            SELECT operator_id, 0, 0, dialer_ptp, answered_calls FROM kpi_dialer_score) x
      GROUP BY operator_id) y""")

cte("kpi_paid_per_rpc", ("fact_payments", "fact_contacts"), f"""
SELECT client_id, SUM(paid) AS paid, CAST(SUM(rpc_count) AS BIGINT) AS rpc_count,
       {_ratio('SUM(paid)', 'SUM(rpc_count)')} AS paid_per_rpc
FROM (SELECT CAST(client_id AS BIGINT) AS client_id, {_money('payed_capital')} AS paid, 0 AS rpc_count
      FROM fact_payments GROUP BY 1
      UNION ALL
      SELECT CAST(client_id AS BIGINT), 0, SUM(is_rpc) FROM fact_contacts GROUP BY 1) u
GROUP BY client_id""")

cte("kpi_commission", ("fact_ptp_enriched", "dim_commission_rules"), f"""
SELECT p.client_id, p.paid, r.commission_rate, p.paid * r.commission_rate AS commission_value
FROM (SELECT client_id, {_money('payed_capital')} AS paid FROM fact_ptp_enriched GROUP BY client_id) p
LEFT JOIN dim_commission_rules r ON r.client_id = p.client_id""")

cte("kpi_forecast_eom", ("fact_payments",), f"""
SELECT Date, CAST(daily AS DOUBLE) AS daily_paid, CAST(cum AS DOUBLE) AS cum_paid,
       elapsed AS workdays_elapsed, total AS total_workdays,
       {_ratio('cum', 'elapsed')} * CAST(total AS DOUBLE) AS forecast_eom
FROM (SELECT d.Date, COALESCE(p.paid, 0) AS daily,
             SUM(COALESCE(p.paid, 0)) OVER (ORDER BY d.Date) AS cum,
             CAST(SUM(CASE WHEN isodow(d.Date) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY d.Date) AS BIGINT)
               AS elapsed,
             CAST(SUM(CASE WHEN isodow(d.Date) <= 5 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS total
      FROM (SELECT CAST(g AS DATE) AS Date
            FROM generate_series(DATE '{_M0}', DATE '{_LAST}', INTERVAL 1 DAY) t(g)) d
      LEFT JOIN (SELECT payment_date, SUM(CAST(payed_capital AS DECIMAL(19, 4))) AS paid
                 FROM fact_payments
                 WHERE payment_date >= DATE '{_M0}' AND payment_date < DATE '{_M1}'
                 GROUP BY payment_date) p ON p.payment_date = d.Date) x""")

_ABS = "CAST(SUM(CASE WHEN attendance_status = 'absent' THEN 1 ELSE 0 END) AS BIGINT)"
_PRE = "CAST(SUM(CASE WHEN attendance_status IN ('present', 'training') THEN 1 ELSE 0 END) AS BIGINT)"
_ELI = ("CAST(SUM(CASE WHEN attendance_status NOT IN ('inactive', 'not_employed') THEN 1 ELSE 0 END)"
        " AS BIGINT)")

cte("kpi_absence", ("fact_operator_presence",), f"""
SELECT users_id, {_ABS} AS absent_days, {_ELI} AS workdays, {_ratio(_ABS, _ELI)} AS absence_pct
FROM fact_operator_presence GROUP BY users_id""")

cte("kpi_presence", ("fact_operator_presence",), f"""
SELECT users_id, {_PRE} AS present_days, {_ELI} AS workdays, {_ratio(_PRE, _ELI)} AS presence_pct
FROM fact_operator_presence GROUP BY users_id""")

cte("kpi_cpc_rate", ("fact_dialer",), f"""
SELECT call_date, COUNT(*) AS total_calls, CAST(SUM(cpc_flag) AS BIGINT) AS cpc_calls,
       {_ratio('SUM(cpc_flag)', 'COUNT(*)')} AS cpc_rate
FROM fact_dialer GROUP BY call_date""")

cte("kpi_not_connected", ("fact_dialer",), f"""
SELECT call_date, CAST(SUM(answered_flag) AS BIGINT) AS answered_calls,
       CAST(SUM(operator_not_connected_flag) AS BIGINT) AS not_connected_calls,
       {_ratio('SUM(operator_not_connected_flag)', 'SUM(answered_flag)')} AS not_connected_pct
FROM fact_dialer GROUP BY call_date""")

cte("kpi_recovery", ("fact_payments", "dim_cases"), f"""
SELECT client_id, CAST(SUM(paid) AS DOUBLE) AS paid, CAST(SUM(actual) AS DOUBLE) AS actual_capital,
       {_ratio('SUM(paid)', 'SUM(actual)')} AS recovery_pct
FROM (SELECT CAST(client_id AS BIGINT) AS client_id, SUM(CAST(payed_capital AS DECIMAL(19, 4))) AS paid,
             0 AS actual FROM fact_payments GROUP BY 1
      UNION ALL
      SELECT CAST(client_id AS BIGINT), 0, SUM(CAST(actual_capital AS DECIMAL(19, 4)))
      FROM dim_cases GROUP BY 1) u
GROUP BY client_id""")

_RATE = (f"(SELECT {_ratio('SUM(CAST(paid AS DECIMAL(38, 4)))', 'SUM(CAST(actual_capital AS DECIMAL(38, 4)))')}"
         " FROM kpi_recovery)")
cte("kpi_recovery_potential", ("kpi_recovery",), f"""
SELECT client_id, actual_capital, {_RATE} AS avg_recovery_rate,
       actual_capital * {_RATE} AS recovery_potential
FROM kpi_recovery""")

cte("kpi_promise_by_cc", ("fact_contacts",), f"""
SELECT operator_id, CAST(SUM(has_promise) AS BIGINT) AS ptp_count, COUNT(*) AS cc_contacts,
       {_ratio('SUM(has_promise)', 'COUNT(*)')} AS promise_by_cc
FROM fact_contacts GROUP BY operator_id""")

_HI = "SUM(CASE WHEN dpd > 180 THEN CAST(paid AS DECIMAL(19, 4)) ELSE 0 END)"
_ALL = "SUM(CAST(paid AS DECIMAL(19, 4)))"
cte("kpi_high_dpd_paid", ("fact_ptp",), f"""
SELECT client_id, CAST({_HI} AS DOUBLE) AS paid_high_dpd, CAST({_ALL} AS DOUBLE) AS paid_total,
       {_ratio(_HI, _ALL)} AS high_dpd_paid_pct
FROM fact_ptp GROUP BY client_id""")

_WOM = "CAST(ceil(day({d}) / 7) AS INTEGER)"
cte("kpi_paid_by_payment_date", ("fact_ptp",), f"""
SELECT payment_date, CAST(year(payment_date) AS INTEGER) AS Year,
       CAST(month(payment_date) AS INTEGER) AS MonthNumber,
       CAST(year(payment_date) * 100 + month(payment_date) AS INTEGER) AS YearMonthKey,
       {_WOM.format(d='payment_date')} AS WeekOfMonth, {_money('paid')} AS paid
FROM fact_ptp GROUP BY payment_date""")

_DW = _WOM.format(d="Date")
cte("dim_date", ("payments", "ptp_overview", "contact_events", "dialer_calls"), f"""
SELECT Date, CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS MonthNumber,
       CAST(quarter(Date) AS INTEGER) AS Quarter, strftime(Date, '%Y-%m') AS MonthYear,
       CAST(year(Date) * 100 + month(Date) AS INTEGER) AS YearMonthKey,
       CAST(isodow(Date) AS INTEGER) AS WeekDayNumber, isodow(Date) >= 6 AS IsWeekend,
       false AS IsHoliday, isodow(Date) <= 5 AS IsBusinessDay, CAST(week(Date) AS INTEGER) AS WeekNumber,
       {_DW} AS WeekOfMonth, strftime(Date, '%b') || ' W' || CAST({_DW} AS VARCHAR) AS WeekOfMonthLabel,
       make_date(CAST(year(Date) AS INTEGER), CAST(month(Date) AS INTEGER), ({_DW} - 1) * 7 + 1)
         AS WeekOfMonthKey
FROM (SELECT CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS Date
      FROM (SELECT CAST(date_trunc('year', min(d)) AS TIMESTAMP) AS lo,
                   CAST(greatest(CAST(max(d) AS DATE), DATE '{max(D.EVENTS_AS_OF, D.ORDERS_AS_OF)}' + 365)
                        AS TIMESTAMP) AS hi
            FROM (SELECT CAST(payment_date AS TIMESTAMP) AS d FROM payments
                  UNION ALL SELECT unnest([contact_date, promise_date, last_payment_date]::TIMESTAMP[]) FROM ptp_overview
                  UNION ALL SELECT contact_date FROM contact_events
                  UNION ALL SELECT call_date FROM dialer_calls)) b) d""")

cte("dim_commission_rules_v", ("dim_commission_rules",),
    "SELECT client_id, commission_rate FROM dim_commission_rules")

# ---------------------------------------------------------------- marts
cte("mart_dialer_outcomes", ("fact_dialer",), f"""
SELECT call_date, COUNT(*) AS total_calls,
       {_ratio("SUM(CASE WHEN disposition = 'ANSWERED' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS answered_pct,
       {_ratio("SUM(CASE WHEN disposition = 'FAILED' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS failed_pct,
       {_ratio("SUM(CASE WHEN disposition = 'NO ANSWER' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS no_answer_pct
FROM fact_dialer GROUP BY call_date""")

cte("mart_operator_ranking", ("kpi_quality_score",), """
SELECT operator_id, quality_score,
       CAST(RANK() OVER (ORDER BY quality_score DESC) AS INTEGER) AS score_rank
FROM kpi_quality_score""")

cte("mart_paid_by_client", ("fact_ptp_enriched",), f"""
SELECT client_id, company_name, {_money('payed_capital')} AS paid, COUNT(payment_id) AS payments
FROM fact_ptp_enriched GROUP BY client_id, company_name""")

cte("mart_weekly_pace", ("fact_ptp_enriched",), f"""
SELECT {_WOM.format(d='payment_date')} AS WeekOfMonth, {_money('payed_capital')} AS paid,
       COUNT(*) AS payments
FROM fact_ptp_enriched WHERE payment_date IS NOT NULL GROUP BY 1""")


def _matrix_sql() -> str:
    d0 = D.EVENTS_CALENDAR_START
    days = [d0 + dt.timedelta(days=i) for i in range((D.EVENTS_AS_OF - d0).days + 1)]
    cols = ",\n       ".join(
        f"MAX(CASE WHEN WorkDate = DATE '{d.isoformat()}' THEN attendance_status END) AS \"{d.isoformat()}\""
        for d in days if d.weekday() < 5)
    return f"SELECT users_id, user_name,\n       {cols}\nFROM fact_operator_presence GROUP BY users_id, user_name"


cte("mart_attendance_matrix", ("fact_operator_presence",), _matrix_sql())

cte("mart_absence_by_week", ("fact_operator_presence",), f"""
SELECT CAST(year(WorkDate) AS INTEGER) AS Year, CAST(week(WorkDate) AS INTEGER) AS WeekNumber,
       {_ABS} AS absent_days, {_ELI} AS workdays, {_ratio(_ABS, _ELI)} AS absence_pct
FROM fact_operator_presence GROUP BY 1, 2""")

_PAIDP = "CAST(SUM(CASE WHEN was_paid = 'paid' THEN 1 ELSE 0 END) AS BIGINT)"
cte("mart_paid_by_uf", ("fact_ptp",), f"""
SELECT uf, COUNT(*) AS promises, {_PAIDP} AS paid_promises, {_money('paid')} AS paid,
       {_ratio(_PAIDP, 'COUNT(*)')} AS was_paid_pct
FROM fact_ptp GROUP BY uf""")

cte("mart_dpd_analysis", ("fact_ptp",), f"""
SELECT dpd_range, COUNT(*) AS promises, {_money('promise_capital')} AS promise_capital,
       {_money('paid')} AS paid
FROM fact_ptp GROUP BY dpd_range""")

cte("mart_portfolio", ("dim_cases",), f"""
SELECT client_id, provider, COUNT(*) AS cases, {_money('actual_capital')} AS actual_capital
FROM dim_cases GROUP BY client_id, provider""")

cte("mart_contacts_by_hour", ("fact_contacts",), """
SELECT contact_hour, COUNT(*) AS contacts, CAST(SUM(has_promise) AS BIGINT) AS promises
FROM fact_contacts GROUP BY contact_hour""")

cte("mart_operator_day", ("fact_operator_presence", "fact_dialer", "fact_contacts"), """
SELECT g.users_id, g.WorkDate, g.attendance_status, g.contact_count,
       COALESCE(c.calls, 0) AS calls, COALESCE(c.answered_calls, 0) AS answered_calls,
       COALESCE(c.cpc_calls, 0) AS cpc_calls, COALESCE(p.promises, 0) AS promises
FROM fact_operator_presence g
LEFT JOIN (SELECT operator_id, call_date, COUNT(*) AS calls,
                  CAST(SUM(answered_flag) AS BIGINT) AS answered_calls,
                  CAST(SUM(cpc_flag) AS BIGINT) AS cpc_calls
           FROM fact_dialer GROUP BY operator_id, call_date) c
  ON c.operator_id = g.users_id AND c.call_date = g.WorkDate
LEFT JOIN (SELECT operator_id, contact_date, CAST(SUM(has_promise) AS BIGINT) AS promises
           FROM fact_contacts GROUP BY operator_id, contact_date) p
  ON p.operator_id = g.users_id AND p.contact_date = g.WorkDate""")

cte("mart_non_dialer_ptp", ("fact_contacts",), """
SELECT contact_channel, COUNT(*) AS ptp_count
FROM fact_contacts WHERE has_promise = 1 AND contact_channel <> 'Dialer'
GROUP BY contact_channel""")

# -------------------------------------------------------------- quality
_PK = {
    "fact_dialer": ("dialer_call_id",),
    "fact_contacts": ("contact_id",),
    "fact_payments": ("payment_id",),
    "cc_operator_activity": ("user_id", "user_name", "contact_date"),
    "fact_operator_presence": ("users_id", "WorkDate"),
    "dim_operators": ("user_id",),
    "dim_cases": ("case_id",),
    "dim_client": ("client_id",),
    "fact_ptp": ("case_id", "client_id", "provider", "operator_norm", "operator_name", "operator_id", "type",
                 "payment_number", "contact_date", "promise_date", "payment_date", "dpd", "ddd",
                 "contact_attribute"),
    "fact_ptp_enriched": ("case_id", "promise_date", "payment_id"),
    "dim_company": ("client_id",),
    "dim_date": ("Date",),
    "dim_commission_rules": ("client_id",),
}


def _pk_part(ds, keys):
    k = ", ".join(keys)
    isnull = " OR ".join(f"{c} IS NULL" for c in keys)
    return (f"SELECT '{ds}' AS dataset, CAST(SUM(n) AS BIGINT) AS row_count, "
            f"CAST(SUM(CASE WHEN {isnull} THEN n ELSE 0 END) AS BIGINT) AS null_keys, "
            f"CAST(SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys "
            f"FROM (SELECT {k}, COUNT(*) AS n FROM {ds} GROUP BY {k}) g")


cte("dq_primary_keys", tuple(_PK), "\nUNION ALL\n".join(_pk_part(d, k) for d, k in _PK.items()))

_FK = [
    ("case.client_id", "dim_cases", "client_id", "dim_company", "client_id"),
    ("cc.user_id", "cc_operator_activity", "user_id", "dim_operators", "user_id"),
    ("ptp.case_id", "fact_ptp", "case_id", "dim_cases", "case_id"),
    ("ptp.client_id", "fact_ptp", "client_id", "dim_company", "client_id"),
    ("ptp.operator_id", "fact_ptp", "operator_id", "dim_operators", "user_id"),
    ("dialer.case_id", "fact_dialer", "case_id", "dim_cases", "case_id"),
    ("dialer.client_id", "fact_dialer", "client_id", "dim_company", "client_id"),
    ("dialer.operator_id", "fact_dialer", "operator_id", "dim_operators", "user_id"),
    ("commission.client_id", "dim_commission_rules", "client_id", "dim_company", "client_id"),
    ("presence.users_id", "fact_operator_presence", "users_id", "dim_operators", "user_id"),
    ("contacts.case_id", "fact_contacts", "case_id", "dim_cases", "case_id"),
    ("contacts.client_id", "fact_contacts", "client_id", "dim_company", "client_id"),
    ("contacts.operator_id", "fact_contacts", "operator_id", "dim_operators", "user_id"),
    ("enriched.client_id", "fact_ptp_enriched", "client_id", "dim_company", "client_id"),
    ("operator_day.users_id", "mart_operator_day", "users_id", "dim_operators", "user_id"),
    ("payments.client_id", "fact_payments", "client_id", "dim_company", "client_id"),
    ("client.company_id", "dim_client", "company_id", "company", "company_id"),
]
_FK_DATES = [
    ("ptp.contact_date", "fact_ptp", "contact_date"), ("ptp.promise_date", "fact_ptp", "promise_date"),
    ("ptp.payment_date", "fact_ptp", "payment_date"), ("dialer.call_date", "fact_dialer", "call_date"),
    ("presence.WorkDate", "fact_operator_presence", "WorkDate"),
    ("contacts.contact_date", "fact_contacts", "contact_date"),
    ("enriched.payment_date", "fact_ptp_enriched", "payment_date"),
    ("operator_day.WorkDate", "mart_operator_day", "WorkDate"),
    ("payments.payment_date", "fact_payments", "payment_date"),
]
cte("dq_foreign_keys", tuple({t for r in _FK for t in (r[1], r[3])} | {f for _, f, _ in _FK_DATES}
                             | {"dim_date"}),
    "\nUNION ALL\n".join(
        [f"SELECT '{n}' AS relationship, COUNT(*) AS orphan_rows FROM {f} x "
         f"WHERE x.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {d} y "
         f"WHERE CAST(y.{pk} AS BIGINT) = CAST(x.{fk} AS BIGINT))" for n, f, fk, d, pk in _FK]
        + [f"SELECT '{n}' AS relationship, COUNT(*) AS orphan_rows FROM {f} x "
           f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_date y WHERE y.Date = x.{c})"
           for n, f, c in _FK_DATES]))

cte("dq_fanout", ("recent_calls", "fact_dialer", "recent_contacts", "fact_contacts", "payments",
                  "fact_payments", "promise_totals", "fact_ptp", "month_money", "fact_ptp_enriched", "view_agg_cc",
                  "cc_operator_activity", "view_cross_presence", "fact_operator_presence"), "\nUNION ALL\n".join(
    f"SELECT '{n}' AS dataset, b.base_rows, f.fact_rows, f.fact_rows - b.base_rows AS extra_rows "
    f"FROM (SELECT COUNT(*) AS base_rows FROM {b}) b, (SELECT COUNT(*) AS fact_rows FROM {f}) f"
    for n, b, f in [("fact_dialer", "recent_calls", "fact_dialer"),
                    ("fact_contacts", "recent_contacts", "fact_contacts"),
                    ("fact_payments", "payments", "fact_payments"), ("fact_ptp", "promise_totals", "fact_ptp"),
                    ("fact_ptp_enriched", "month_money", "fact_ptp_enriched"),
                    ("cc_operator_activity", "view_agg_cc", "cc_operator_activity"),
                    ("fact_operator_presence", "view_cross_presence", "fact_operator_presence")]))

_DOM = [
    ("fact_contacts", "contact_channel", ("WhatsApp", "RCS", "SMS", "Email", "BOT", "Dialer", "Manual")),
    ("fact_ptp", "was_paid", ("paid", "not paid")),
    ("fact_ptp_enriched", "ptp_status", ("PAID", "OVERDUE", "DUE")),
    ("fact_ptp_enriched", "money_type", ("NEW MONEY", "OLD MONEY")),
    ("fact_operator_presence", "attendance_status",
     ("not_employed", "inactive", "training", "present", "absent")),
]
cte("dq_value_domains", tuple({d for d, _, _ in _DOM}), "\nUNION ALL\n".join(
    f"SELECT '{d}.{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL OR {c} NOT IN "
    f"({', '.join(repr(v) for v in vals)}) THEN 1 ELSE 0 END) AS BIGINT) AS bad_rows FROM {d}"
    for d, c, vals in _DOM))

cte("dq_flag_implications", ("fact_dialer",), """
SELECT CAST(SUM(CASE WHEN cpc_flag = 1 AND answered_flag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cpc_not_answered,
       CAST(SUM(CASE WHEN operator_not_connected_flag = 1 AND answered_flag = 0 THEN 1 ELSE 0 END) AS BIGINT)
         AS not_connected_not_answered,
       CAST(SUM(CASE WHEN cpc_flag = 1 AND operator_not_connected_flag = 1 THEN 1 ELSE 0 END) AS BIGINT)
         AS cpc_and_not_connected
FROM fact_dialer""")

cte("dq_debtor_cases", ("cases",), """
SELECT debtor_id, COUNT(*) AS cases FROM cases
WHERE debtor_id IS NOT NULL GROUP BY debtor_id HAVING COUNT(*) > 1""")

cte("dq_presence_completeness", ("dim_operators", "business_days", "fact_operator_presence"), """
SELECT o.operators, w.business_days, o.operators * w.business_days AS expected_rows, p.actual_rows
FROM (SELECT COUNT(*) AS operators FROM dim_operators WHERE is_operator = 'Yes') o,
     (SELECT COUNT(*) AS business_days FROM business_days) w,
     (SELECT COUNT(*) AS actual_rows FROM fact_operator_presence) p""")

cte("dq_client_ids", ("fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched",
                      "fact_payments", "client"), "\nUNION ALL\n".join(
    f"SELECT '{f}' AS dataset, "
    f"CAST(SUM(CASE WHEN CAST(client_id AS BIGINT) IN (1, 999) THEN 1 ELSE 0 END) AS BIGINT) AS reserved_rows, "
    f"CAST(SUM(CASE WHEN client_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM client c "
    f"WHERE CAST(c.client_id AS BIGINT) = CAST(x.client_id AS BIGINT)) THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS unknown_client_rows FROM {f} x"
    for f in ("fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched", "fact_payments")))

# ------------------------------------------------------ operator views
def _inventory_sql() -> str:
    from arrears.sources.schemas import SCHEMAS
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS relation, COUNT(*) AS row_count, {len(SCHEMAS[n].split(','))} AS column_count "
        f"FROM {n}" for n in SCHEMAS)


cte("view_scan_inventory", tuple(__import__("arrears.sources.schemas", fromlist=["SCHEMAS"]).SCHEMAS),
    _inventory_sql())

cte("view_month_window", ("ptp_overview",), f"""
SELECT ptp_id, case_id, promise_date FROM ptp_overview
WHERE promise_date >= DATE '{_M0}' AND promise_date < DATE '{_M1}'""")

cte("view_not_in_null", ("month_promise",), """
SELECT case_id, ref_number, state FROM month_promise
WHERE state NOT IN ('Expired', 'Canceled')""")

cte("view_eav_303", ("case_attributes",), """
SELECT case_id, attribute_value FROM case_attributes WHERE attribute_type = 303""")

cte("view_try_cast_sip", ("users",), f"""
SELECT user_id, sip_account AS sip_text, {whole_number('sip_account')} AS sip_number FROM users""")

cte("view_interval_join_15m", ("recent_contacts", "dialer_calls"), """
SELECT cb.contact_id, COUNT(*) AS matches
FROM recent_contacts cb
JOIN dialer_calls d
  ON d.telecom_id = cb.telecom_id AND d.case_id = cb.case_id
 AND d.call_date BETWEEN cb.contact_date - INTERVAL 15 MINUTE AND cb.contact_date + INTERVAL 15 MINUTE
GROUP BY cb.contact_id""")

cte("view_interval_latest", ("call_match",), """
SELECT contact_id, dialer_contact_id, campaign_id, campaign_name, dialer_call_id
FROM call_match""")

cte("view_join_norm_name", ("ptp_overview", "users"), f"""
SELECT o.ptp_id, LOWER(TRIM(o.operator)) AS operator_norm, u.user_id AS operator_id
FROM ptp_overview o
LEFT JOIN users u ON LOWER(TRIM(u.full_name)) = LOWER(TRIM(o.operator))""")

cte("view_join_two_hop", ("cases", "client", "company"), """
SELECT c.case_id, c.client_id, co.company_id, co.company_name
FROM cases c
LEFT JOIN client cl ON cl.client_id = c.client_id
LEFT JOIN company co ON co.company_id = cl.company_id""")

cte("view_exists_prev_payment", ("payments",), f"""
SELECT pay.payment_id, pay.ref_number, pay.payment_date,
       CASE WHEN EXISTS (SELECT 1 FROM payments h
                         WHERE h.ref_number = pay.ref_number AND h.payment_date < pay.payment_date
                           AND h.payment_date >= CAST(make_date(year(pay.payment_date),
                                                                month(pay.payment_date), 1)
                                                      - INTERVAL 1 MONTH AS DATE))
            THEN 1 ELSE 0 END AS has_previous_payment
FROM payments pay
WHERE pay.payment_date >= DATE '{_M0}' AND pay.payment_date < DATE '{_M1}'""")

cte("view_exists_prev_month", ("month_promise", "payments"), f"""
SELECT p.case_id, p.ref_number,
       CASE WHEN EXISTS (SELECT 1 FROM payments h WHERE h.ref_number = p.ref_number
                         AND h.payment_date >= DATE '{_PM}' AND h.payment_date < DATE '{_M0}')
            THEN 1 ELSE 0 END AS has_previous_payment
FROM month_promise p""")

cte("view_anti_unpaid", ("month_promise", "payments"), f"""
SELECT p.case_id, p.ref_number FROM month_promise p
WHERE NOT EXISTS (SELECT 1 FROM payments pay WHERE pay.ref_number = p.ref_number
                               AND pay.payment_date >= DATE '{_M0}' AND pay.payment_date < DATE '{_M1}')""")

cte("view_cross_presence", ("dim_operators", "business_days"), """
SELECT o.user_id AS users_id, w.WorkDate FROM dim_operators o CROSS JOIN business_days w
WHERE o.is_operator = 'Yes'""")

cte("view_star_join", ("fact_payments", "fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched",
                       "cc_operator_activity", "fact_operator_presence", "mart_operator_day", "dim_client", "dim_cases",
                       "dim_operators", "dim_date", "dim_commission_rules"), """
SELECT f.fact, k.company_name, own.company_name AS case_company, r.commission_rate, c.provider, c.case_status_id,
       o.is_operator, d.YearMonthKey, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(f.amount) AS DOUBLE) AS amount
FROM (SELECT 'payments' AS fact, client_id, case_id, NULL AS operator_id, payment_date AS day,
             CAST(payed_capital AS DECIMAL(19, 4)) AS amount FROM fact_payments
      UNION ALL SELECT 'dialer', client_id, case_id, operator_id, call_date, 0 FROM fact_dialer
      UNION ALL SELECT 'contacts', client_id, case_id, operator_id, contact_date, 0 FROM fact_contacts
      UNION ALL SELECT 'ptp', client_id, case_id, operator_id, contact_date,
                       CAST(promise_capital AS DECIMAL(19, 4)) FROM fact_ptp
      UNION ALL SELECT 'enriched', client_id, case_id, NULL, payment_date,
                       CAST(payed_capital AS DECIMAL(19, 4)) FROM fact_ptp_enriched
      UNION ALL SELECT 'activity', NULL, NULL, user_id, contact_date, contact_count FROM cc_operator_activity
      UNION ALL SELECT 'presence', NULL, NULL, users_id, WorkDate, contact_count FROM fact_operator_presence
      UNION ALL SELECT 'operator_day', NULL, NULL, users_id, WorkDate, promises FROM mart_operator_day) f
LEFT JOIN dim_client k ON k.client_id = f.client_id
LEFT JOIN dim_commission_rules r ON r.client_id = f.client_id
LEFT JOIN dim_cases c ON c.case_id = f.case_id
LEFT JOIN dim_client own ON own.client_id = c.client_id
LEFT JOIN dim_operators o ON o.user_id = f.operator_id
LEFT JOIN dim_date d ON d.Date = f.day
GROUP BY ALL""")

cte("view_role_date", ("fact_ptp", "dim_date"), "\nUNION ALL\n".join(f"""
SELECT '{role}' AS role, d.YearMonthKey, d.WeekOfMonth, count(*) AS promises,
       {_money('promise_capital')} AS promise_capital, {_money('paid')} AS paid
FROM fact_ptp p LEFT JOIN dim_date d ON d.Date = p.{role} GROUP BY ALL"""
    for role in ("contact_date", "promise_date", "payment_date")))

def _landing_sql() -> str:
    from arrears.sources.schemas import SCHEMAS
    from arrears.sources.sink import LANDING_PARTITIONS
    from arrears.plans.views import LEAST_ROWS_PER_DAY

    def days(n):
        if n not in LANDING_PARTITIONS:
            return "CAST(0 AS BIGINT)"
        d = f"COUNT(DISTINCT CAST({LANDING_PARTITIONS[n]} AS DATE))"
        return f"CASE WHEN COUNT(*) >= {LEAST_ROWS_PER_DAY} * {d} THEN {d} ELSE 0 END"

    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS relation, COUNT(*) AS row_count, {len(SCHEMAS[n].split(',')) + 2} AS column_count, "
        f"COUNT(*) AS sourced_rows, COUNT(*) AS stamped_rows, {days(n)} AS days FROM {n}" for n in SCHEMAS)


cte("view_bronze_landing", tuple(__import__("arrears.sources.schemas", fromlist=["SCHEMAS"]).SCHEMAS), _landing_sql())

cte("view_agg_cc", ("contact_events",), f"""
SELECT LOWER(TRIM(insert_user)) AS user_name, CAST(contact_date AS DATE) AS contact_date,
       COUNT(*) AS contact_count
FROM contact_events
WHERE target_type_id IN (1, 2, 5, 6) AND insert_user NOT IN ('system_user', 'auto_process')
  AND contact_date >= DATE '{S}' AND contact_date < DATE '{E}' + INTERVAL 1 DAY
GROUP BY 1, 2""")

cte("view_dedup_contact_ptp", ("last_promise",), """
SELECT contact_id, ptp_contact_date, promise_capital, promise_capital_total, promise_date
FROM last_promise""")

cte("view_dedup_bridge", ("bridge_latest",), """
SELECT unique_id, sip_account, contact_id FROM bridge_latest""")

cte("view_dedup_ptp_month", ("month_promise",), """
SELECT case_id, client_id, ref_number, client_ref_number, operator, promise_date,
       promise_capital_total, promise_capital, contact_date, number_of_installments,
       payment_number, state
FROM month_promise""")

cte("view_dialer_state", ("fact_dialer",), """
SELECT dialer_call_id,
       CASE WHEN billsec_sec = 0 THEN 'NO_ANSWER'
            WHEN billsec_sec > 3 AND dialer_sip_account IS NULL THEN 'NO_OPERATOR'
            WHEN billsec_sec >= 40 AND dialer_sip_account IS NOT NULL THEN 'HUMAN (CPC)'
            ELSE 'OTHER' END AS dialer_state
FROM fact_dialer""")

# ------------------------------------------------------------- listings
cte("sorted_fact_dialer", ("fact_dialer",),
    "SELECT * FROM fact_dialer ORDER BY call_datetime DESC NULLS LAST, dialer_call_id DESC")
cte("sorted_fact_ptp_enriched", ("fact_ptp_enriched",),
    "SELECT * FROM fact_ptp_enriched ORDER BY ref_number NULLS FIRST, payment_date NULLS FIRST, "
    "payment_id NULLS FIRST")
cte("sorted_fact_operator_presence", ("fact_operator_presence",),
    "SELECT * FROM fact_operator_presence ORDER BY WorkDate DESC, full_name NULLS FIRST, users_id")

# ------------------------------------------------------------------- cube
_DEC = "CAST(SUM(CAST({} AS DECIMAL(19, 4))) AS DECIMAL(38, 8))"
#: Facts of the cube: source, client, operator, day, states.
_CUBE = [
    ("fact_dialer", "client_id", "operator_id", "call_date", {
        "total_calls": "COUNT(*)", "answered_calls": "SUM(answered_flag)", "cpc_calls": "SUM(cpc_flag)",
        "not_connected_calls": "SUM(operator_not_connected_flag)"}),
    ("fact_contacts", "client_id", "operator_id", "contact_date", {
        "contacts": "COUNT(*)", "promises": "SUM(has_promise)", "rpc_count": "SUM(is_rpc)",
        "dialer_ptp": "COUNT(*) FILTER (has_promise = 1 AND contact_channel = 'Dialer')"}),
    ("fact_ptp", "client_id", "operator_id", "contact_date", {
        "ptp_count": "COUNT(*)", "paid_promised": _DEC.format("paid"),
        "paid_high_dpd": _DEC.format("CASE WHEN dpd > 180 THEN paid ELSE 0 END")}),
    ("""(SELECT e.client_id, e.promise_date, u.user_id AS operator_id, r.commission_rate AS rate, e.paid, e.money
         FROM (SELECT client_id, operator, case_id, ref_number, promise_date,
                      max(CAST(ptp_status = 'PAID' AS INTEGER)) AS paid, SUM(CAST(payed_capital AS DECIMAL(19, 4))) AS money
               FROM fact_ptp_enriched GROUP BY ALL) e
         LEFT JOIN users u ON lower(trim(u.full_name)) = lower(trim(e.operator))
         LEFT JOIN dim_commission_rules r ON r.client_id = e.client_id)""", "client_id", "operator_id", "promise_date", {
        "total_ptp": "COUNT(*)", "paid_ptp": "SUM(paid)", "enriched_paid": "CAST(SUM(money) AS DECIMAL(38, 8))",
        "commission": "CAST(SUM(CAST(money AS DECIMAL(24, 4)) * CAST(rate AS DECIMAL(9, 4))) AS DECIMAL(38, 8))"}),
    ("fact_payments", "client_id", "NULL", "payment_date", {"paid": _DEC.format("payed_capital")}),
    ("cc_operator_activity", "NULL", "user_id", "contact_date", {"cc_contacts": "SUM(contact_count)"}),
    ("fact_operator_presence", "NULL", "users_id", "WorkDate", {
        "absent_days": "COUNT(*) FILTER (attendance_status = 'absent')",
        "present_days": "COUNT(*) FILTER (attendance_status IN ('present', 'training'))",
        "workdays": "COUNT(*) FILTER (attendance_status NOT IN ('inactive', 'not_employed'))"}),
    ("dim_cases", "client_id", "NULL", "CAST(NULL AS DATE)", {"actual_capital": _DEC.format("actual_capital")}),
]


def _cube_sql() -> str:
    from arrears.plans.cube import COUNTS, MONEY, RATIOS
    parts = []
    for source, client, seat, day, states in _CUBE:
        cols = ", ".join(f"{states[c]} AS {c}" if c in states else f"NULL AS {c}" for c in (*COUNTS, *MONEY))
        parts.append(f"SELECT CAST({client} AS BIGINT) AS client_id, CAST({seat} AS BIGINT) AS operator_id, "
                     f"CAST(date_trunc('week', {day}) AS DATE) AS week, {cols} FROM {source} x GROUP BY 1, 2, 3")
    sums = ", ".join([*[f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in COUNTS], *[f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in MONEY]])
    ratios = ", ".join(f"{_ratio(n, d)} AS {k}" for k, (n, d) in RATIOS.items())
    return (f"SELECT *, {ratios} FROM (SELECT CAST(GROUPING_ID(client_id, operator_id, week) AS INTEGER) AS level, client_id, "
            f"operator_id, week, {sums} FROM ({' UNION ALL '.join(parts)}) u GROUP BY CUBE (client_id, operator_id, week)) c")


cte("kpi_cube", ("fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched", "fact_payments", "cc_operator_activity",
                 "fact_operator_presence", "dim_cases", "users", "dim_commission_rules"), _cube_sql())

# ---------------------------------------------------------- stored tables
cte("stored_calls_of_week", ("fact_dialer", "dim_date", "dim_client"), """
SELECT f.call_date, d.YearMonthKey, k.company_name, COUNT(*) AS calls, CAST(SUM(f.answered_flag) AS BIGINT) AS answered_calls
FROM fact_dialer f JOIN dim_date d ON d.Date = f.call_date JOIN dim_client k ON k.client_id = f.client_id
WHERE d.WeekOfMonth = 2 AND k.company_name = 'ASIA' GROUP BY ALL""")

cte("view_typed_users_load", ("users",), f"""
WITH t AS (
    SELECT user_id % 13 = 0 AS cut, user_id % 11 = 0 AND user_id % 13 <> 0 AS no_date,
           sip_account IS NOT NULL AND {whole_number('sip_account')} IS NULL AND user_id % 13 <> 0 AS no_sip
    FROM users)
SELECT outcome, column_name, reason, n FROM (
    SELECT 'read' AS outcome, '' AS column_name, '' AS reason, COUNT(*) AS n FROM t
    UNION ALL SELECT 'accepted', '', '', COUNT(*) FROM t WHERE NOT (cut OR no_date OR no_sip)
    UNION ALL SELECT 'rejected', '', '', COUNT(*) FROM t WHERE cut OR no_date OR no_sip
    UNION ALL SELECT 'cell', '', 'not the declared fields', COUNT(*) FROM t WHERE cut
    UNION ALL SELECT 'cell', 'insert_date', 'no date', COUNT(*) FROM t WHERE no_date
    UNION ALL SELECT 'cell', 'sip_account', 'no int', COUNT(*) FROM t WHERE no_sip) x
WHERE n > 0""")

cte("view_try_cast_sip_number", ("users",), """
SELECT user_id, sip_account AS sip_text, TRY_CAST(trim(sip_account) AS DOUBLE) AS sip_number FROM users""")

cte("view_dialer_state_bot", ("fact_dialer",), """
SELECT dialer_call_id,
       CASE WHEN billsec_sec = 0 THEN 'NO_ANSWER' WHEN campaign_id % 11 = 0 THEN 'BOT'
            WHEN billsec_sec > 3 AND dialer_sip_account IS NULL THEN 'NO_OPERATOR'
            WHEN billsec_sec >= 40 AND dialer_sip_account IS NOT NULL THEN 'HUMAN (CPC)' ELSE 'OTHER' END AS dialer_state
FROM fact_dialer""")

# --------------------------------------------------- quality, with trouble
cte("dq_fanout_plain", ("promise_totals", "fact_ptp_plain_provider", "dim_cases", "dim_cases_plain_provider"),
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS dataset, b.n AS base_rows, f.n AS fact_rows, f.n - b.n AS extra_rows "
        f"FROM (SELECT COUNT(*) AS n FROM {b}) b, (SELECT COUNT(*) AS n FROM {f}) f"
        for n, b, f in (("fact_ptp", "promise_totals", "fact_ptp_plain_provider"),
                        ("dim_cases", "dim_cases", "dim_cases_plain_provider"))))

cte("dq_documented_keys", ("fact_ptp", "fact_ptp_enriched"), "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dataset, CAST(SUM(n) AS BIGINT) AS row_count, CAST(SUM(n) FILTER ({no}) AS BIGINT) AS null_keys, "
    f"COUNT(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(SUM(n - 1) FILTER (n > 1), 0) AS BIGINT) AS surplus_rows "
    f"FROM (SELECT {k}, COUNT(*) AS n FROM {d} GROUP BY ALL) g"
    for d, k, no in (("fact_ptp", "case_id, contact_date, operator_norm",
                      "case_id IS NULL OR contact_date IS NULL OR operator_norm IS NULL"),
                     ("fact_ptp_enriched", "ref_number, date_trunc('month', promise_date) AS month",
                      "ref_number IS NULL OR month IS NULL"))).replace(
    "CAST(SUM(n) FILTER (", "CAST(coalesce(SUM(n) FILTER (").replace(") AS BIGINT) AS null_keys", "), 0) AS BIGINT) AS null_keys"))

cte("dq_source_domains", ("dialer_calls", "ptp_overview", "contact_events"), "\nUNION ALL\n".join(
    f"SELECT '{t}.{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) FILTER ({c} IS NULL) AS null_rows, "
    f"COUNT(*) FILTER ({c} NOT IN ({known})) AS unknown_rows FROM {t}"
    for t, c, known in (("dialer_calls", "disposition", "'ANSWERED', 'NO ANSWER', 'FAILED'"),
                        ("ptp_overview", "state", "'Active', 'Expired', 'Fulfilled', 'Canceled'"),
                        ("contact_events", "target_type_id", "1, 2, 3, 4, 5, 6"))))

cte("dq_cross_implications", ("fact_contacts", "fact_dialer", "fact_ptp_enriched"), "\nUNION ALL\n".join(
    f"SELECT '{n}' AS check_name, COUNT(*) AS premise_rows, COUNT(*) FILTER ({broken}) AS broken_rows FROM {t} WHERE {given}"
    for n, t, given, broken in (
        ("contact_campaign_without_bridge", "fact_contacts", "campaign_id IS NOT NULL", "dialer_contact_id IS NULL"),
        ("answered_call_without_bridge", "fact_dialer", "answered_flag = 1", "contact_id IS NULL"),
        ("payment_before_promise", "fact_ptp_enriched", "ptp_status = 'PAID'", "payment_date < promise_date"))))

cte("dq_debtor_fanout", ("fact_dialer", "fact_contacts", "fact_ptp", "fact_payments", "cases"), """
WITH f AS (SELECT 'fact_dialer' AS fact, CAST(case_id AS BIGINT) AS case_id FROM fact_dialer
           UNION ALL SELECT 'fact_contacts', CAST(case_id AS BIGINT) FROM fact_contacts
           UNION ALL SELECT 'fact_ptp', CAST(case_id AS BIGINT) FROM fact_ptp
           UNION ALL SELECT 'fact_payments', CAST(case_id AS BIGINT) FROM fact_payments),
owned AS (SELECT f.fact, c.debtor_id FROM f JOIN cases c ON CAST(c.case_id AS BIGINT) = f.case_id WHERE c.debtor_id IS NOT NULL),
joined AS (SELECT o.fact, o.debtor_id, COUNT(*) AS n FROM owned o JOIN cases c ON c.debtor_id = o.debtor_id GROUP BY ALL)
SELECT fact, (SELECT COUNT(*) FROM owned o WHERE o.fact = j.fact) AS fact_rows, CAST(SUM(n) AS BIGINT) AS joined_rows,
       MAX(n) AS largest_debtor
FROM joined j GROUP BY fact""")

cte("dq_presence_gaps", ("view_cross_presence", "fact_operator_presence"), f"""
SELECT g.users_id, COUNT(*) AS missing_days, MIN(g.WorkDate) AS first_missing
FROM view_cross_presence g
ANTI JOIN (SELECT users_id, WorkDate FROM fact_operator_presence WHERE (users_id + (WorkDate - DATE '{S}')) % 5 <> 0) p
  ON p.users_id = g.users_id AND p.WorkDate = g.WorkDate
GROUP BY g.users_id""")

# --------------------------------------------------- streams, upkeep, profiles
cte("view_calls_once", ("dialer_calls",), "SELECT DISTINCT uniqueid, CAST(1 AS BIGINT) AS copies FROM dialer_calls")


def _profile_sql() -> str:
    from arrears.sources.profile import FRACTIONS, PROFILED
    parts = []
    for name, (_, distinct, numbers) in PROFILED.items():
        measures = [(c, "distinct", f"COUNT(DISTINCT {c})") for c in distinct]
        measures += [(c, f"p{round(f * 100)}", f"COUNT({c})") for c in numbers for f in FRACTIONS]
        parts += [f"SELECT '{name}' AS relation, '{c}' AS column_name, '{m}' AS measure, COUNT(*) AS rows, {exact} AS exact, "
                  f"true AS within FROM {name}" for c, m, exact in measures]
    return "\nUNION ALL\n".join(parts)


cte("view_profile_report", ("dialer_calls", "contact_events", "payments"), _profile_sql())
