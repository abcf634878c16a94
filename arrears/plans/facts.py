"""Fact datasets. One function per stage; stages compose lazily into one
logical plan per fact, which Catalyst optimises as a whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import config as C
from arrears.config import Params
from arrears.functions import classify as K
from arrears.functions.dates import at_time, month_bounds, rolling_start, year_start_prev
from arrears.functions.text import money_sum, norm, try_int, try_number
from arrears.operators.asof import latest_per_id, match_rows
from arrears.operators.calendar import explode_workdays
from arrears.operators.dedup import latest_per_key
from arrears.operators.exists import earlier_in_window
from arrears.operators.lookup import attribute_max, ddd_map
from arrears.sources.catalog import Sources

col = F.col


# ============================================================ fact_dialer
def dialer_contact_dedup(src: Sources) -> DataFrame:
    """Latest bridge row per call id.

    The bridge carries no date rule of its own, so its whole history is
    deduplicated; the partial WindowGroupLimit keeps one row per id and map
    task before the single shuffle by id. (Restricting it first to looked-up
    ids by a semi join was measured slower: at scale the id set is too large
    to broadcast, so the bridge is shuffled once either way.)"""
    return latest_per_key(
        src.dialer_contact, ["unique_id"],
        [col("call_date").desc_nulls_last(), col("contact_id").desc_nulls_last(),
         col("sip_account").desc_nulls_last()],
    ).select("unique_id", "sip_account", "contact_id")


def dialer_base(src: Sources, p: Params) -> DataFrame:
    d = src.window("dialer_calls", "call_date", rolling_start(p.as_of, p.rolling_days))
    return d.select(
        col("uniqueid").alias("dialer_call_id"), "queue_item_id", "disposition_code",
        "campaign_id", "campaign_name", "case_id", "debtor_id", "telecom_id", "client_id",
        "phone_number", col("call_date").alias("call_datetime"),
        F.to_date("call_date").alias("call_date"),
        F.coalesce("duration", F.lit(0)).alias("duration_sec"),
        F.coalesce("billsec", F.lit(0)).alias("billsec_sec"),
        "disposition", "hangup_cause")


def users_by_sip(src: Sources) -> DataFrame:
    return src.users.select(col("user_id").alias("operator_id"),
                            col("user_name").alias("operator_name"),
                            try_int("sip_account").alias("_usip"))


FACT_DIALER_COLUMNS = (
    "dialer_call_id", "queue_item_id", "disposition_code", "campaign_id", "campaign_name",
    "case_id", "debtor_id", "telecom_id", "client_id", "phone_number", "call_datetime",
    "call_date", "duration_sec", "billsec_sec", "disposition", "hangup_cause", "contact_id",
    "dialer_sip_account", "operator_id", "operator_name", "answered_flag",
    "operator_not_connected_flag", "cpc_flag")


def fact_dialer(src: Sources, p: Params) -> DataFrame:
    """One row per call attempt in the rolling window, with bridge, operator
    and call flags. Users sharing a sip fan out (kept, reported by DQ3)."""
    d = dialer_base(src, p)
    dc = dialer_contact_dedup(src).select(
        col("unique_id").alias("_uid"), col("sip_account").alias("dialer_sip_account"),
        "contact_id")
    x = d.join(dc, d["dialer_call_id"] == dc["_uid"], "left")
    x = x.withColumn("_dsip", try_int("dialer_sip_account"))
    u = users_by_sip(src)
    x = x.join(u, x["_dsip"] == u["_usip"], "left")
    sip = col("dialer_sip_account")
    return x.select(
        *FACT_DIALER_COLUMNS[:-3],
        K.answered_flag(col("billsec_sec")).alias("answered_flag"),
        K.operator_not_connected_flag(col("billsec_sec"), sip).alias("operator_not_connected_flag"),
        K.cpc_flag(col("billsec_sec"), sip).alias("cpc_flag"))


# ========================================================== fact_contacts
def contact_base(src: Sources, p: Params) -> DataFrame:
    c = src.window("contact_events", "contact_date", rolling_start(p.as_of, p.rolling_days))
    return c.where(~col("insert_user").isin(*C.EXCLUDED_LOGINS)).select(
        "contact_id", "case_id", "telecom_id", "description", "contact_date",
        "status_type_id", "target_type_id", "contact_text",
        norm("insert_user").alias("operator_login"))


def manual_campaign_match(src: Sources, p: Params, base: DataFrame | None = None) -> DataFrame:
    """Latest call of the same telecom and case within +-tolerance of each
    contact, with its bridge contact id."""
    cb = base if base is not None else contact_base(src, p)
    # Calls before (window start - tolerance) can never match: exact prune.
    lo = dt.datetime.combine(rolling_start(p.as_of, p.rolling_days), dt.time()) \
        - dt.timedelta(minutes=p.tolerance_minutes)
    calls = (src.window("dialer_calls", "call_date", lo)
             .select("uniqueid", "telecom_id", "case_id", "call_date", "campaign_id",
                     "campaign_name"))
    m = match_rows(cb, calls, keys=["telecom_id", "case_id"], left_id="contact_id",
                   left_ts="contact_date", right_ts="call_date", tie="uniqueid",
                   payload=["uniqueid", "campaign_id", "campaign_name"],
                   tolerance_minutes=p.tolerance_minutes, bucket_minutes=p.match_bucket_minutes)
    # Bridge lookup before the per-contact reduction: the reduction's
    # partitioning by contact id then serves the join back to the contacts.
    dc = dialer_contact_dedup(src).select(col("unique_id").alias("_uid"),
                                          col("contact_id").alias("_dcid"))
    m = (m.join(dc, col("match.uniqueid") == dc["_uid"], "left")
          .select("contact_id", col("match").withField("dialer_contact_id", col("_dcid")).alias("match")))
    return (latest_per_id(m, "contact_id",
                          ["dialer_contact_id", "campaign_id", "campaign_name", "uniqueid"])
            .withColumnRenamed("uniqueid", "dialer_call_id"))


def ptp_dedup(src: Sources) -> DataFrame:
    """Latest promise per contact id (partial top-1 before the shuffle)."""
    ptp = src.ptp_overview.where(col("contact_id").isNotNull())
    return latest_per_key(ptp, ["contact_id"],
                          [col("promise_date").desc_nulls_last(), col("ptp_id").desc()]).select(
        "contact_id", col("contact_date").alias("ptp_contact_date"), "promise_capital",
        "promise_capital_total", "promise_date")


FACT_CONTACTS_COLUMNS = (
    "contact_id", "dialer_contact_id", "case_id", "client_id", "telecom_id",
    "contact_datetime", "contact_date", "contact_hour", "operator_id", "operator_name",
    "operator_login", "contact_text", "status_type_id", "target_type_id", "campaign_id",
    "campaign_name", "derived_from_dialer_flag", "ptp_contact_date", "promise_capital",
    "promise_capital_total", "promise_date", "has_promise", "flag_bot", "flag_whatsapp",
    "flag_rcs", "flag_sms", "flag_email", "status_label", "contact_channel", "is_cpc",
    "is_rpc")


def fact_contacts(src: Sources, p: Params) -> DataFrame:
    cb = contact_base(src, p)
    mcm = manual_campaign_match(src, p, cb).drop("dialer_call_id")
    mcm = mcm.withColumnRenamed("contact_id", "_mid")
    ptp = ptp_dedup(src).withColumnRenamed("contact_id", "_pid")
    u = src.users.select(col("user_name").alias("_login"), col("user_id").alias("operator_id"),
                         col("full_name").alias("operator_name"))
    cs = src.cases.select(col("case_id").alias("_cid"), "client_id")
    x = (cb.join(u, cb["operator_login"] == u["_login"], "left")
           .join(cs, cb["case_id"] == cs["_cid"], "left")
           .join(mcm, cb["contact_id"] == mcm["_mid"], "left")
           .join(ptp, cb["contact_id"] == ptp["_pid"], "left"))
    text, camp = col("contact_text"), col("campaign_id")
    status, target = col("status_type_id"), col("target_type_id")
    return x.select(
        "contact_id", "dialer_contact_id", "case_id", "client_id", "telecom_id",
        col("contact_date").alias("contact_datetime"),
        F.to_date("contact_date").alias("contact_date"),
        F.hour("contact_date").alias("contact_hour"),
        "operator_id", "operator_name", "operator_login", "contact_text",
        "status_type_id", "target_type_id", "campaign_id", "campaign_name",
        K.derived_from_dialer_flag(camp).alias("derived_from_dialer_flag"),
        "ptp_contact_date", "promise_capital", "promise_capital_total", "promise_date",
        K.has_promise(col("_pid")).alias("has_promise"),
        K.text_flag(text, "bot").alias("flag_bot"),
        K.text_flag(text, "whats").alias("flag_whatsapp"),
        K.text_flag(text, "rcs").alias("flag_rcs"),
        K.text_flag(text, "sms").alias("flag_sms"),
        K.text_flag(text, "email").alias("flag_email"),
        K.status_label(status).alias("status_label"),
        K.contact_channel(text, col("description"), camp).alias("contact_channel"),
        K.is_cpc(target).alias("is_cpc"),
        K.is_rpc(target, status).alias("is_rpc"))


# ================================================================ fact_ptp
def ptp_period(p: Params) -> tuple[dt.date, dt.date]:
    """[1 Jan of last year, day after as_of)."""
    return year_start_prev(p.as_of), p.as_of + dt.timedelta(days=1)


def _in(c, lo, hi):
    return (col(c) >= F.lit(lo)) & (col(c) < F.lit(hi))


def contact_time(src: Sources, p: Params) -> DataFrame:
    s, e = ptp_period(p)
    return (src.promises_information.where(_in("contact_date", s, e))
            .groupBy(col("case_id"), F.to_date("contact_date").alias("contact_date"),
                     norm("operator").alias("operator_norm"))
            .agg(F.max("contact_time").alias("contact_time")))


def installment_time(src: Sources, p: Params) -> DataFrame:
    s, e = ptp_period(p)
    return (src.installment.where(_in("insert_date", s, e))
            .groupBy(col("case_id"), F.to_date("insert_date").alias("contact_date"))
            .agg(F.date_format(F.min("insert_date"), "HH:mm:ss").alias("contact_time")))


def provider_rows(src: Sources, p: Params) -> DataFrame:
    """(_acid, provider): the max type-303 attribute of a case ("max"), or
    one row per such attribute ("join", the source's plain join)."""
    if p.provider_mode == "join":
        return (src.case_attributes.where(col("attribute_type") == C.PROVIDER_ATTRIBUTE_TYPE)
                .select(col("case_id").alias("_acid"), col("attribute_value").alias("provider")))
    return attribute_max(src.case_attributes, C.PROVIDER_ATTRIBUTE_TYPE).withColumnRenamed("case_id", "_acid")


def case_provider(src: Sources, p: Params) -> DataFrame:
    """(case_id, provider) for every case in ``cases``."""
    cases, a = src.cases.select("case_id"), provider_rows(src, p)
    return cases.join(a, cases["case_id"] == a["_acid"], "left").select("case_id", "provider")


PROMISE_KEYS = ("case_id", "client_id", "provider", "operator_norm", "operator_name",
                "operator_id", "type", "payment_number", "contact_date", "promise_date",
                "payment_date", "dpd", "ddd", "contact_attribute")


def promise_base(src: Sources, p: Params) -> DataFrame:
    s, e = ptp_period(p)
    o = src.ptp_overview.where(_in("contact_date", s, e))
    u = src.users.select(norm("full_name").alias("_uname"), col("user_id").alias("operator_id"))
    cp = case_provider(src, p).withColumnRenamed("case_id", "_pcid")
    x = (o.join(u, norm(o["operator"]) == u["_uname"], "left")
          .join(cp, o["case_id"] == cp["_pcid"], "left"))
    keyed = x.select(
        "case_id", "client_id", F.trim("provider").alias("provider"),
        norm("operator").alias("operator_norm"), col("operator").alias("operator_name"),
        "operator_id", "type", "payment_number",
        F.to_date("contact_date").alias("contact_date"),
        F.to_date("promise_date").alias("promise_date"),
        col("last_payment_date").alias("payment_date"), "dpd",
        K.area_code(col("phone_number")).alias("ddd"),
        K.contact_attribute(col("contact_attribute")).alias("contact_attribute"),
        "promise_capital", "paid")
    return keyed.groupBy(*PROMISE_KEYS).agg(money_sum("promise_capital").alias("promise_capital"),
                                            money_sum("paid").alias("paid"))


def promise_enriched(src: Sources, p: Params) -> DataFrame:
    b = promise_base(src, p)
    m = ddd_map(src.spark).withColumnRenamed("ddd", "_ddd")
    return (b.join(m, b["ddd"] == m["_ddd"], "left").drop("_ddd")
             .withColumn("was_paid", K.was_paid(col("paid")))
             .withColumn("dpd_range", K.dpd_range(col("dpd"))))


FACT_PTP_COLUMNS = PROMISE_KEYS + ("promise_capital", "paid", "uf", "was_paid", "dpd_range",
                                   "contact_time", "contact_datetime")


def fact_ptp(src: Sources, p: Params) -> DataFrame:
    pe = promise_enriched(src, p)
    ct = contact_time(src, p).select(col("case_id").alias("_c1"), col("contact_date").alias("_d1"),
                                     col("operator_norm").alias("_o1"),
                                     col("contact_time").alias("_t1"))
    it = installment_time(src, p).select(col("case_id").alias("_c2"),
                                         col("contact_date").alias("_d2"),
                                         col("contact_time").alias("_t2"))
    x = (pe.join(ct, (pe["case_id"] == ct["_c1"]) & (pe["contact_date"] == ct["_d1"])
                 & (pe["operator_norm"] == ct["_o1"]), "left")
           .join(it, (pe["case_id"] == it["_c2"]) & (pe["contact_date"] == it["_d2"]), "left"))
    t = F.coalesce(col("_t1"), col("_t2"))
    x = x.withColumn("contact_time", t).withColumn(
        "contact_datetime", F.when(t.isNull(), F.lit(None)).otherwise(at_time(col("contact_date"), t)))
    return x.select(*FACT_PTP_COLUMNS)


# ======================================================= fact_ptp_enriched
def ptp_month_base(src: Sources, p: Params) -> DataFrame:
    """Canonical promise per case and promise month (current month only):
    installments first, then largest total, then latest contact."""
    _, m0, m1 = month_bounds(p.as_of)
    ptp = src.window("ptp_overview", "promise_date", m0, m1)
    return latest_per_key(
        ptp, ["case_id", F.year("promise_date"), F.month("promise_date")],
        [F.when(col("type") == "Installment", 1).otherwise(2).asc(),
         col("promise_capital_total").desc_nulls_last(), col("contact_date").desc_nulls_last(),
         col("ptp_id").desc()],
    ).select("case_id", "client_id", "ref_number", "client_ref_number", "operator",
             "promise_date", "promise_capital_total", "promise_capital", "contact_date",
             "number_of_installments", "payment_number", "state")


def payment_history(src: Sources, p: Params) -> DataFrame:
    """Payments from the first day of last month (or 30 days before this
    month, whichever is earlier) to the end of this month: every row the
    month's classification can look at."""
    prev_m, m0, m1 = month_bounds(p.as_of)
    lo = min(prev_m, m0 - dt.timedelta(days=30)) if p.old_money_window == "30d" else prev_m
    return src.window("payments", "payment_date", lo, m1).select(
        "payment_id", "ref_number", "payment_date", "payed_capital")


def previous_payment_flags(src: Sources, p: Params) -> DataFrame:
    """(ref_number, payment_date, has_previous_payment): an earlier payment of
    the same ref exists since the first day of the payment's previous month."""
    h = payment_history(src, p)
    if p.old_money_window == "30d":
        start = F.date_sub("payment_date", 30)
    else:
        start = F.add_months(F.trunc("payment_date", "MM"), -1)
    return earlier_in_window(h, "ref_number", "payment_date", start)


UNION_COLUMNS = ("case_id", "client_id", "ref_number", "client_ref_number", "operator",
                 "promise_date", "promise_capital_total", "promise_capital", "contact_date",
                 "number_of_installments", "payment_number", "state", "payment_id",
                 "payment_date", "payed_capital", "has_previous_payment")


def payments_month(src: Sources, p: Params, base: DataFrame | None = None) -> DataFrame:
    _, m0, m1 = month_bounds(p.as_of)
    pb = base if base is not None else ptp_month_base(src, p)
    pay = payment_history(src, p).where(_in("payment_date", m0, m1))
    flags = previous_payment_flags(src, p)
    pay = (pay.join(flags, ["ref_number", "payment_date"], "left")
              .withColumnRenamed("ref_number", "_ref"))
    return (pb.join(pay, pb["ref_number"] == pay["_ref"], "inner")
              .withColumn("has_previous_payment", F.coalesce("has_previous_payment", F.lit(0)))
              .select(*UNION_COLUMNS))


def ref_month_flags(src: Sources, p: Params) -> DataFrame:
    """Per ref: paid in the as-of month (``_cur``) / in the month before
    (``_prev``). Built on the distinct (ref, day) table of
    ``previous_payment_flags`` (the same plan, so Spark reuses its shuffle),
    which is already partitioned by ref: this aggregation adds no exchange."""
    prev_m, m0, m1 = month_bounds(p.as_of)
    d = col("payment_date")
    return (previous_payment_flags(src, p)
            .groupBy("ref_number")
            .agg(F.max(F.when((d >= F.lit(m0)) & (d < F.lit(m1)), 1).otherwise(0)).alias("_cur"),
                 F.max(F.when((d >= F.lit(prev_m)) & (d < F.lit(m0)), 1).otherwise(0)).alias("_prev")))


def ptp_without_payment(src: Sources, p: Params, base: DataFrame | None = None) -> DataFrame:
    """Open canonical promises with no payment this month (NOT EXISTS) and
    whether the ref paid last month (EXISTS): one left join on per-ref
    flags instead of an anti join plus a semi join."""
    pb = base if base is not None else ptp_month_base(src, p)
    pb = pb.where(~col("state").isin(*C.CLOSED_PTP_STATES))
    fl = ref_month_flags(src, p).withColumnRenamed("ref_number", "_fref")
    x = (pb.join(fl, pb["ref_number"] == fl["_fref"], "left")
           .where(F.coalesce(col("_cur"), F.lit(0)) == 0)
           .withColumn("has_previous_payment", F.coalesce(col("_prev"), F.lit(0))))
    return x.select(
        *UNION_COLUMNS[:12], F.lit(None).cast("string").alias("payment_id"),
        F.lit(None).cast("date").alias("payment_date"), F.lit(0.0).alias("payed_capital"),
        "has_previous_payment")


FACT_PTP_ENRICHED_COLUMNS = (
    "case_id", "client_id", "company_name", "ref_number", "client_ref_number", "operator",
    "promise_date", "promise_capital_total", "promise_capital", "number_of_installments",
    "payment_number", "provider", "payment_id", "payment_date", "payed_capital",
    "money_type", "ptp_status")


def client_company(src: Sources) -> DataFrame:
    """client -> company, the two-hop path every fact must take."""
    cl, co = src.client, src.company
    return (cl.join(co, cl["company_id"] == co["company_id"], "left")
              .select(cl["client_id"], cl["company_id"], co["company_name"]))


def fact_ptp_enriched(src: Sources, p: Params) -> DataFrame:
    pb = ptp_month_base(src, p)
    x = payments_month(src, p, pb).unionByName(ptp_without_payment(src, p, pb))
    cc = client_company(src).select(col("client_id").alias("_clid"), "company_name")
    prov = attribute_max(src.case_attributes, C.PROVIDER_ATTRIBUTE_TYPE).withColumnRenamed(
        "case_id", "_pcid")
    x = (x.join(cc, x["client_id"] == cc["_clid"], "left")
          .join(prov, x["case_id"] == prov["_pcid"], "left"))
    return x.select(
        *FACT_PTP_ENRICHED_COLUMNS[:15],
        K.money_type(col("has_previous_payment")).alias("money_type"),
        K.ptp_status(col("payment_date"), col("promise_date"), p.as_of).alias("ptp_status"))


# =========================================================== fact_payments
def fact_payments(src: Sources, p: Params | None = None) -> DataFrame:
    pay, ci = src.payments, src.cases_information
    ci = ci.select(col("case_id").alias("_cid"), "dpd_original", "original_capital",
                   "actual_capital", "case_statute_id")
    return pay.join(ci, pay["case_id"] == ci["_cid"], "left").select(
        "payment_id", "client_id", "case_id", "payment_date", "payed_capital",
        "payed_plus_money", "payed_administrative_assessment", "payed_delay_charge",
        "dpd_original", "original_capital", "actual_capital", "case_statute_id")


# ===================================================== operator activity
def activity_counts(src: Sources, p: Params) -> DataFrame:
    """Counted contacts per normalised login and day."""
    end = p.as_of + dt.timedelta(days=1)
    ce = src.window("contact_events", "contact_date", p.calendar_start, end).where(
        col("target_type_id").isin(*C.CC_TARGET_TYPES)
        & ~col("insert_user").isin(*C.EXCLUDED_LOGINS))
    return (ce.groupBy(norm("insert_user").alias("user_name"),
                       F.to_date("contact_date").alias("contact_date"))
              .agg(F.count(F.lit(1)).alias("contact_count")))


def cc_operator_activity(src: Sources, p: Params) -> DataFrame:
    """Contacts per operator login and day. Counted per (login, day) first,
    then joined to users (the same result as joining first, with one row
    per group crossing the join instead of one per contact)."""
    agg = activity_counts(src, p)
    u = src.users.select(col("user_id"), norm("user_name").alias("_login"))
    return (agg.join(u, agg["user_name"] == u["_login"], "left")
               .select("user_id", "user_name", "contact_date", "contact_count"))


def dim_operators(src: Sources, p: Params) -> DataFrame:
    u = src.users
    sip = try_number("sip_account")
    return u.select(
        "user_id", "user_name", "full_name", "user_status",
        K.is_inactive(col("user_status")).alias("is_inactive"),
        K.is_operator(sip, p.strict_sip).alias("is_operator"),
        sip.alias("sip_account"),
        F.to_date("insert_date").alias("insert_date"),
        F.to_date("update_date").alias("update_date"))


FACT_PRESENCE_COLUMNS = ("users_id", "user_name", "full_name", "insert_date", "update_date",
                         "sip_account", "WorkDate", "contact_count", "attendance_status")


def fact_operator_presence(src: Sources, p: Params) -> DataFrame:
    """Operator x business day grid with an attendance status. The grid is
    generated per operator row (no join with a calendar table)."""
    ops = dim_operators(src, p).where(col("is_operator") == "Yes")
    grid = explode_workdays(ops, p.calendar_start, p.as_of).withColumn("_login", norm("user_name"))
    cc = cc_operator_activity(src, p).select(col("user_name").alias("_cc_login"),
                                             col("contact_date").alias("_cc_date"),
                                             "contact_count")
    x = grid.join(cc, (grid["_login"] == cc["_cc_login"]) & (grid["WorkDate"] == cc["_cc_date"]),
                  "left")
    end = F.coalesce(col("update_date"), F.lit(p.as_of))
    return x.select(
        col("user_id").alias("users_id"), "user_name", "full_name", "insert_date",
        "update_date", "sip_account", "WorkDate", "contact_count",
        K.attendance_status(col("WorkDate"), col("insert_date"), end, col("contact_count"),
                            user_status=col("user_status") if p.require_inactive_status else None)
        .alias("attendance_status"))
