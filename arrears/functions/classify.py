"""Business classifiers: one function per rule, each a plain Column.

They stay inside whole-stage codegen (no UDFs). Null handling follows the
source rules: ``ISNULL(x, 0)`` becomes ``coalesce``; a searched CASE whose
condition is null falls through to the next branch / ELSE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrears import config as C
from arrears.functions.text import concat_text, contains_ci


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# --- dialer call flags ------------------------------------------------------
def answered_flag(billsec: Column) -> Column:
    return _flag(F.coalesce(billsec, F.lit(0)) > C.ANSWERED_MIN_BILLSEC)


def operator_not_connected_flag(billsec: Column, sip: Column) -> Column:
    return _flag((F.coalesce(billsec, F.lit(0)) > C.NOT_CONNECTED_MIN_BILLSEC) & sip.isNull())


def cpc_flag(billsec: Column, sip: Column) -> Column:
    return _flag((F.coalesce(billsec, F.lit(0)) >= C.CPC_MIN_BILLSEC) & sip.isNotNull())


def dialer_state(billsec: Column, sip: Column, is_bot: Column | None = None) -> Column:
    """Documented call states. Calls the rules leave uncovered (1-3 s; or
    4-39 s with an operator) get ``OTHER``; the bot rule is not specified,
    so ``BOT`` is emitted only where ``is_bot`` (given by the caller) holds for an answered call."""
    b = F.coalesce(billsec, F.lit(0))
    bot = F.lit(False) if is_bot is None else F.coalesce(is_bot, F.lit(False))
    return (F.when(b == 0, "NO_ANSWER")
            .when(bot, "BOT")
            .when((b > C.NOT_CONNECTED_MIN_BILLSEC) & sip.isNull(), "NO_OPERATOR")
            .when((b >= C.CPC_MIN_BILLSEC) & sip.isNotNull(), "HUMAN (CPC)")
            .otherwise("OTHER"))


# --- contact classifiers ----------------------------------------------------
def derived_from_dialer_flag(campaign_id: Column) -> Column:
    return _flag(campaign_id.isNotNull())


def has_promise(ptp_contact_id: Column) -> Column:
    return _flag(ptp_contact_id.isNotNull())


# Channel words searched in the contact text, in priority order.
CHANNEL_WORDS = (("whats", "WhatsApp"), ("rcs", "RCS"), ("sms", "SMS"), ("email", "Email"))
BOT_WORD = "bot"


def text_flag(text: Column, word: str) -> Column:
    return _flag(contains_ci(text, word))


# Status numbers and their labels.
def status_label(status: Column) -> Column:
    return (F.when(status.isin(2, 300), "Agreement")
            .when(status.isin(118, 119, 120), "Negotiation")
            .when(status == 48, "No Contact Attempt")
            .when(status == 8, "No Interaction")
            .otherwise(concat_text("Status_", status)))


def contact_channel(text: Column, description: Column, campaign_id: Column) -> Column:
    """First match wins: WhatsApp, RCS, SMS, Email (text), BOT (description),
    Dialer (matched call), Manual."""
    expr = None
    for word, label in CHANNEL_WORDS:
        cond = contains_ci(text, word)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return (expr.when(contains_ci(description, BOT_WORD), "BOT")
            .when(campaign_id.isNotNull(), "Dialer")
            .otherwise("Manual"))


def is_cpc(target: Column) -> Column:
    return _flag(target.isin(*C.CPC_TARGET_TYPES))


def is_rpc(target: Column, status: Column) -> Column:
    return _flag((target == C.RPC_TARGET_TYPE) & status.isin(*C.RPC_STATUS_TYPES))


# --- promise classifiers ----------------------------------------------------
def contact_attribute(attr: Column) -> Column:
    return F.when(attr.isNull() | (attr == "NULL"), "Outgoing Call").otherwise(attr)


def area_code(phone: Column) -> Column:
    return F.substring(phone, 3, 2)


def was_paid(paid: Column) -> Column:
    return F.when(paid == 0, "not paid").otherwise("paid")


# Days-past-due bands (inclusive bounds), in order.
DPD_BANDS = ((0, 15), (16, 30), (31, 60), (61, 90), (91, 120), (121, 180), (181, 360))


def dpd_range(dpd: Column) -> Column:
    expr = None
    for lo, hi in DPD_BANDS:
        cond = dpd.between(lo, hi)
        label = f"DPD {lo}-{hi}"
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("DPD 360+")


# Labels of money and of a promise's state.
def money_type(has_previous_payment: Column) -> Column:
    return F.when(has_previous_payment == 1, "OLD MONEY").otherwise("NEW MONEY")


def ptp_status(payment_date: Column, promise_date: Column, as_of) -> Column:
    return (F.when(payment_date.isNotNull(), "PAID")
            .when(promise_date < F.lit(as_of), "OVERDUE")
            .otherwise("DUE"))


# --- operator classifiers ---------------------------------------------------
def is_inactive(user_status: Column) -> Column:
    """``status <> 1`` where a null status counts as different."""
    return F.when(~user_status.eqNullSafe(1), "Yes").otherwise("No")


def is_operator(sip_number: Column, strict: bool = False) -> Column:
    """``sip >= 200``. A missing sip made the source rule fail and the error
    was replaced by "Yes"; ``strict`` applies the documented rule instead."""
    missing = "No" if strict else "Yes"
    return (F.when(sip_number.isNull(), missing)
            .when(sip_number >= C.OPERATOR_MIN_SIP, "Yes")
            .otherwise("No"))


# Labels of attendance.
def attendance_status(work_day: Column, start: Column, end: Column, activity: Column,
                      training_days: int = C.TRAINING_DAYS,
                      user_status: Column | None = None) -> Column:
    """Ordered rules: not_employed, inactive, training, present, absent.
    ``end`` is the leaving date (already defaulted to ``as_of``). A null
    hire date makes the first comparison unknown: the status is null. With
    ``user_status`` given, "inactive" also needs a status other than 1."""
    training_end = F.date_add(start, training_days)
    gone = work_day >= end
    if user_status is not None:
        gone = gone & ~user_status.eqNullSafe(1)
    return (F.when(start.isNull(), F.lit(None).cast("string"))
            .when(work_day < start, "not_employed")
            .when(gone, "inactive")
            .when((work_day >= start) & (work_day < training_end), "training")
            .when(activity.isNotNull() & (activity > 0), "present")
            .otherwise("absent"))
