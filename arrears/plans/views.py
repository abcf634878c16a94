"""Operator-level views: each exposes one stage of a dataset on its own
(the same functions the datasets are composed of), so every operator can
be checked and reused in isolation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import config as C
from arrears.config import Params
from arrears.functions import classify as K
from arrears.functions.dates import month_bounds
from arrears.functions.text import norm, try_int, try_number
from arrears.operators.asof import count_within
from arrears.operators.calendar import explode_workdays
from arrears.operators.exists import flag_if_exists, keys_with_rows, without_match
from arrears.plans import facts
from arrears.plans.kpi import dim_date
from arrears.plans.marts import operator_day
from arrears.plans.model import WRITERS, Model
from arrears.sources.catalog import Sources
from arrears.sources.schemas import SCHEMAS
from arrears.session import shared_path
from arrears.sources.typed import load_report, read_lines, typed
from arrears.sources.sink import LANDING_PARTITIONS, day_span, land_bronze, land_days

col = F.col


def scan_inventory(src: Sources, p: Params | None = None) -> DataFrame:
    """Rows and columns of every source relation, in one job."""
    parts = [src.rel(n).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(n).alias("relation"), "row_count",
                     F.lit(len(src.rel(n).columns)).alias("column_count"))
             for n in SCHEMAS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def month_window(src: Sources, p: Params) -> DataFrame:
    _, m0, m1 = month_bounds(p.as_of)
    return (src.ptp_overview.where((col("promise_date") >= F.lit(m0)) & (col("promise_date") < F.lit(m1)))
            .select("ptp_id", "case_id", "promise_date"))


def not_in_null(src: Sources, p: Params) -> DataFrame:
    return (facts.ptp_month_base(src, p).where(~col("state").isin(*C.CLOSED_PTP_STATES))
            .select("case_id", "ref_number", "state"))


def eav_303(src: Sources, p: Params | None = None) -> DataFrame:
    return (src.case_attributes.where(col("attribute_type") == C.PROVIDER_ATTRIBUTE_TYPE)
            .select("case_id", "attribute_value"))


def try_cast_sip(src: Sources, p: Params | None = None) -> DataFrame:
    return src.users.select("user_id", col("sip_account").alias("sip_text"),
                            try_int("sip_account").alias("sip_number"))


def interval_join_15m(src: Sources, p: Params) -> DataFrame:
    cb = facts.contact_base(src, p)
    return count_within(cb, src.dialer_calls, ["telecom_id", "case_id"], "contact_id",
                        "contact_date", "call_date", p.tolerance_minutes, p.match_bucket_minutes)


def interval_latest(src: Sources, p: Params) -> DataFrame:
    return facts.manual_campaign_match(src, p)


def join_norm_name(src: Sources, p: Params | None = None) -> DataFrame:
    o = src.ptp_overview
    u = src.users.select(norm("full_name").alias("_n"), col("user_id").alias("operator_id"))
    return (o.join(u, norm(o["operator"]) == u["_n"], "left")
             .select("ptp_id", norm("operator").alias("operator_norm"), "operator_id"))


def join_two_hop(src: Sources, p: Params | None = None) -> DataFrame:
    c = src.cases.select("case_id", "client_id")
    cc = facts.client_company(src).withColumnRenamed("client_id", "_cl")
    return (c.join(cc, c["client_id"] == cc["_cl"], "left")
             .select("case_id", "client_id", "company_id", "company_name"))


def exists_prev_payment(src: Sources, p: Params) -> DataFrame:
    _, m0, m1 = month_bounds(p.as_of)
    pay = facts.payment_history(src, p).where((col("payment_date") >= F.lit(m0))
                                              & (col("payment_date") < F.lit(m1)))
    flags = facts.previous_payment_flags(src, p)
    return (pay.join(flags, ["ref_number", "payment_date"], "left")
               .select("payment_id", "ref_number", "payment_date",
                       F.coalesce("has_previous_payment", F.lit(0)).alias("has_previous_payment")))


def exists_prev_month(src: Sources, p: Params) -> DataFrame:
    prev_m, m0, _ = month_bounds(p.as_of)
    pb = facts.ptp_month_base(src, p).select("case_id", "ref_number")
    return flag_if_exists(pb, keys_with_rows(facts.payment_history(src, p), "ref_number",
                                             "payment_date", prev_m, m0),
                          "ref_number", "has_previous_payment")


def anti_unpaid(src: Sources, p: Params) -> DataFrame:
    _, m0, m1 = month_bounds(p.as_of)
    pb = facts.ptp_month_base(src, p).select("case_id", "ref_number")
    return without_match(pb, keys_with_rows(facts.payment_history(src, p), "ref_number",
                                            "payment_date", m0, m1),
                         "ref_number")


def cross_presence(src: Sources, p: Params) -> DataFrame:
    ops = facts.dim_operators(src, p).where(col("is_operator") == "Yes")
    return explode_workdays(ops, p.calendar_start, p.as_of).select(
        col("user_id").alias("users_id"), "WorkDate")


def star_join(m: Model) -> DataFrame:
    """The star's eight facts against client, company, commission rule, case (and the company of
    the case), operator and date.

    A fact meets only the dimensions it has keys of: rows without an operator or a case would all
    come to one task of that join. The joined rows are added up once, by the few values that the
    dimensions give; sums by the facts' own keys would be as many as the rows."""
    none = F.lit(None)

    def part(name, df, day, operator=none, amount=F.lit(0), client=col("client_id"), case=col("case_id")):
        return df.select(F.lit(name).alias("fact"), client.cast("bigint").alias("client_id"),
                         case.cast("bigint").alias("case_id"), operator.cast("bigint").alias("operator_id"),
                         col(day).alias("day"), amount.cast("decimal(19,4)").alias("_a"))

    def union(*parts):
        return reduce(DataFrame.unionByName, parts)

    seat = col("operator_id")
    money = union(part("payments", m.fact_payments, "payment_date", amount=col("payed_capital")),
                  part("enriched", m.fact_ptp_enriched, "payment_date", amount=col("payed_capital")))
    talks = union(part("dialer", m.fact_dialer, "call_date", seat), part("contacts", m.fact_contacts, "contact_date", seat),
                  part("ptp", m.fact_ptp, "contact_date", seat, col("promise_capital")))
    days = union(
        part("activity", m.cc_operator_activity, "contact_date", col("user_id"), col("contact_count"), none, none),
        part("presence", m.fact_operator_presence, "WorkDate", col("users_id"), col("contact_count"), none, none),
        part("operator_day", operator_day(m), "WorkDate", col("users_id"), col("promises"), none, none))
    cl = m.dim_client.select(col("client_id").alias("_cl"), "company_name")
    rule = m.dim_commission_rules.select(col("client_id").alias("_rc"), "commission_rate")
    own = m.dim_client.select(col("client_id").alias("_cc"), col("company_name").alias("case_company"))
    cs = m.dim_cases.select(col("case_id").alias("_cs"), "provider", "case_status_id", col("client_id").alias("_ccl"))
    cs = cs.join(own, cs["_ccl"] == own["_cc"], "left").drop("_cc", "_ccl")
    op = m.dim_operators.select(col("user_id").alias("_op"), "is_operator")
    cal = dim_date(m).select(col("Date").alias("_day"), "YearMonthKey")

    def with_operator(x):
        return x.join(op, x["operator_id"] == op["_op"], "left").drop("_op")

    x = money.withColumn("is_operator", none.cast("string")).unionByName(with_operator(talks))
    x = x.join(cs, x["case_id"] == cs["_cs"], "left").drop("_cs")
    x = x.unionByName(with_operator(days), allowMissingColumns=True)
    return (x.join(cl, x["client_id"] == cl["_cl"], "left")
             .join(rule, x["client_id"] == rule["_rc"], "left")
             .join(cal, x["day"] == cal["_day"], "left")
             .groupBy("fact", "company_name", "case_company", "commission_rate", "provider", "case_status_id",
                      "is_operator", "YearMonthKey")
             .agg(F.count(F.lit(1)).alias("row_count"),
                  F.sum(col("_a").cast("decimal(38,4)")).cast("double").alias("amount")))


def role_date(m: Model) -> DataFrame:
    """Promises by month with the calendar joined on the contact, the promise
    and the payment date in turn: one pass over the fact emits a row per
    role, added up by day before the calendar is joined."""
    roles = F.inline(F.array(*[F.struct(F.lit(c).alias("role"), col(c).alias("day"))
                               for c in ("contact_date", "promise_date", "payment_date")]))
    money = [F.sum(col(c).cast("decimal(19,4)")).cast("decimal(38,4)").alias(c) for c in ("promise_capital", "paid")]
    days = (m.fact_ptp.select(roles, "promise_capital", "paid").groupBy("role", "day")
            .agg(F.count(F.lit(1)).alias("_n"), *money))
    cal = dim_date(m).select(col("Date").alias("_day"), "YearMonthKey", "WeekOfMonth")
    return (days.join(cal, days["day"] == cal["_day"], "left").groupBy("role", "YearMonthKey", "WeekOfMonth")
            .agg(F.sum("_n").alias("promises"), F.sum("promise_capital").cast("double").alias("promise_capital"),
                 F.sum("paid").cast("double").alias("paid")))


#: Event relations with smaller days are landed whole by the query.
LEAST_ROWS_PER_DAY = 30


def bronze_landing(src: Sources, p: Params | None = None) -> DataFrame:
    """Land every relation, then the first day of each relation in day folders twice more, and
    report what the files hold: rows, columns (without the day folder), rows with the lineage
    source, rows with an ingestion time, days (0: not by day)."""
    base = shared_path(src.spark, "bronze")

    def land(name: str) -> DataFrame:
        rows, days, first = day_span(src, name) if name in LANDING_PARTITIONS else (0, 1, None)
        by_day = rows >= LEAST_ROWS_PER_DAY * days
        land_bronze(src, base, relations=[name], partition=by_day, files_per_day=1)
        for _ in range(2 if by_day else 0):
            land_days(src, base, name, [first] if first else [], files_per_day=1)
        return src.spark.read.parquet(f"{base}/{name}")

    # The event relations, which take longest, start first; small ones fill what they leave idle.
    order = sorted(SCHEMAS, key=lambda name: name not in LANDING_PARTITIONS)
    for name in order:
        src.rel(name)
    with ThreadPoolExecutor(WRITERS) as pool:
        landed = dict(zip(order, pool.map(land, order)))
    out = None
    for name in SCHEMAS:
        df = landed[name]
        days = F.count_distinct("_day") if "_day" in df.columns else F.lit(0).cast("bigint")
        part = df.agg(F.count(F.lit(1)).alias("row_count"),
                      F.count(F.when(col("_source") == f"operational.{name}", 1)).alias("sourced_rows"),
                      F.count("_ingested_at").alias("stamped_rows"), days.alias("days")).select(
            F.lit(name).alias("relation"), "row_count", F.lit(len(set(df.columns) - {"_day"})).alias("column_count"),
            "sourced_rows", "stamped_rows", "days")
        out = part if out is None else out.unionByName(part)
    return out


#: Declared types of the users file; sip accounts are whole numbers.
USERS_FILE = ("user_id int, user_name string, full_name string, user_status int, sip_account int, "
              "insert_date date, update_date date")


def typed_users_load(src: Sources, p: Params | None = None) -> DataFrame:
    """What a typed load of the users' text export accepts and rejects. Every eleventh user's
    hire date is no date, and every thirteenth line lost its last two fields."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    hired = F.when(col("user_id") % 11 == 0, F.lit("2024-13-01")).otherwise(text("insert_date"))
    first = F.concat_ws(",", *[text(c) for c in ("user_id", "user_name", "full_name", "user_status", "sip_account")])
    line = F.when(col("user_id") % 13 == 0, first).otherwise(F.concat_ws(",", first, hired, text("update_date")))
    path = shared_path(src.spark, "users-text")
    src.users.select(line.alias("value")).write.text(path)
    return load_report(typed(read_lines(src.spark, path), USERS_FILE))


def try_cast_sip_number(src: Sources, p: Params | None = None) -> DataFrame:
    """The sip as any number (null where the text is none), as the operator rule reads it."""
    return src.users.select("user_id", col("sip_account").alias("sip_text"), try_number("sip_account").alias("sip_number"))


def agg_cc(src: Sources, p: Params) -> DataFrame:
    return facts.activity_counts(src, p)


def dedup_contact_ptp(src: Sources, p: Params | None = None) -> DataFrame:
    return facts.ptp_dedup(src)


def dedup_bridge(src: Sources, p: Params | None = None) -> DataFrame:
    return facts.dialer_contact_dedup(src)


def dedup_ptp_month(src: Sources, p: Params) -> DataFrame:
    return facts.ptp_month_base(src, p)


def union_paid_unpaid(src: Sources, p: Params) -> DataFrame:
    pb = facts.ptp_month_base(src, p)
    return facts.payments_month(src, p, pb).unionByName(facts.ptp_without_payment(src, p, pb))


def dialer_state(m: Model) -> DataFrame:
    d = m.fact_dialer
    return d.select("dialer_call_id",
                    K.dialer_state(col("billsec_sec"), col("dialer_sip_account")).alias("dialer_state"))


def dialer_state_bot(m: Model) -> DataFrame:
    """The states where a caller says which campaigns are bots (here: every eleventh)."""
    d = m.fact_dialer
    state = K.dialer_state(col("billsec_sec"), col("dialer_sip_account"), col("campaign_id") % 11 == 0)
    return d.select("dialer_call_id", state.alias("dialer_state"))
