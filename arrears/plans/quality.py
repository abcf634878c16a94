"""Model-integrity and data-quality reports (one DataFrame per check).

Each report is a union of small per-dataset aggregates, so one action
evaluates every check of a family; nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.plans.dims import dim_cases
from arrears.plans.facts import PROMISE_KEYS, activity_counts, contact_base, dialer_base, fact_ptp, promise_base
from arrears.plans.kpi import dim_date
from arrears.plans.marts import operator_day
from arrears.plans.model import Model
from arrears.plans.views import cross_presence, union_paid_unpaid

col = F.col


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The reports below write what they need of the facts once and look at the tables.
# DQ1
KEYS = {
    "fact_dialer": ("dialer_call_id",),
    "fact_contacts": ("contact_id",),
    "fact_payments": ("payment_id",),
    "cc_operator_activity": ("user_id", "user_name", "contact_date"),
    "fact_operator_presence": ("users_id", "WorkDate"),
    "dim_operators": ("user_id",),
    "dim_cases": ("case_id",),
    "dim_client": ("client_id",),
    "fact_ptp": PROMISE_KEYS,
    "fact_ptp_enriched": ("case_id", "promise_date", "payment_id"),
    "dim_company": ("client_id",),
    "dim_date": ("Date",),
    "dim_commission_rules": ("client_id",),
}
FACTS = ("fact_dialer", "fact_contacts", "fact_payments", "cc_operator_activity", "fact_operator_presence", "fact_ptp",
         "fact_ptp_enriched")


def primary_keys(m: Model) -> DataFrame:
    """Per dataset: rows, rows with a null key part, key values seen twice+."""
    m = m.stored({n: KEYS[n] for n in (*FACTS, "dim_cases")}, dim_date=dim_date(m))
    parts = []
    for name, keys in KEYS.items():
        df = getattr(m, name)
        anynull = F.lit(False)
        for k in keys:
            anynull = anynull | col(k).isNull()
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(g.agg(
            F.sum("_n").cast("bigint").alias("row_count"),
            F.sum(F.when(anynull, col("_n")).otherwise(0)).cast("bigint").alias("null_keys"),
            F.sum(F.when(col("_n") > 1, 1).otherwise(0)).cast("bigint").alias("duplicate_keys"),
        ).select(F.lit(name).alias("dataset"), "row_count", "null_keys", "duplicate_keys"))
    return _union(parts)


# DQ2
def fk_checks(m: Model) -> list[tuple[str, DataFrame, str, DataFrame, str]]:
    """The key relationships of the star (fact, fk, dimension, pk). Clients
    are looked up in the company table keyed by client, which leaves the
    reserved client ids out."""
    client, case, seat = (m.dim_company, "client_id"), (m.dim_cases, "case_id"), (m.dim_operators, "user_id")
    return [
        ("case.client_id", m.dim_cases, "client_id", *client),
        ("cc.user_id", m.cc_operator_activity, "user_id", *seat),
        ("ptp.case_id", m.fact_ptp, "case_id", *case),
        ("ptp.client_id", m.fact_ptp, "client_id", *client),
        ("ptp.operator_id", m.fact_ptp, "operator_id", *seat),
        ("dialer.case_id", m.fact_dialer, "case_id", *case),
        ("dialer.client_id", m.fact_dialer, "client_id", *client),
        ("dialer.operator_id", m.fact_dialer, "operator_id", *seat),
        ("commission.client_id", m.dim_commission_rules, "client_id", *client),
        ("presence.users_id", m.fact_operator_presence, "users_id", *seat),
        ("contacts.case_id", m.fact_contacts, "case_id", *case),
        ("contacts.client_id", m.fact_contacts, "client_id", *client),
        ("contacts.operator_id", m.fact_contacts, "operator_id", *seat),
        ("enriched.client_id", m.fact_ptp_enriched, "client_id", *client),
        ("operator_day.users_id", m.operator_day, "users_id", *seat),
        ("payments.client_id", m.fact_payments, "client_id", *client),
        ("client.company_id", m.dim_client, "company_id", m.src.company, "company_id"),
    ]


def fk_date_checks(m: Model) -> list[tuple[str, DataFrame, str]]:
    """Role-playing date keys that must exist in the calendar (dim_date)."""
    return [
        ("ptp.contact_date", m.fact_ptp, "contact_date"),
        ("ptp.promise_date", m.fact_ptp, "promise_date"),
        ("ptp.payment_date", m.fact_ptp, "payment_date"),
        ("dialer.call_date", m.fact_dialer, "call_date"),
        ("presence.WorkDate", m.fact_operator_presence, "WorkDate"),
        ("contacts.contact_date", m.fact_contacts, "contact_date"),
        ("enriched.payment_date", m.fact_ptp_enriched, "payment_date"),
        ("operator_day.WorkDate", m.operator_day, "WorkDate"),
        ("payments.payment_date", m.fact_payments, "payment_date"),
    ]


#: What the relationships and the operator-day table use of the facts.
REFERENCES = {
    "fact_dialer": ("case_id", "client_id", "operator_id", "call_date", "answered_flag", "cpc_flag"),
    "fact_contacts": ("case_id", "client_id", "operator_id", "contact_date", "has_promise"),
    "fact_payments": ("client_id", "payment_date"),
    "cc_operator_activity": ("user_id",),
    "fact_operator_presence": ("users_id", "WorkDate", "attendance_status", "contact_count"),
    "fact_ptp": ("case_id", "client_id", "operator_id", "contact_date", "promise_date", "payment_date"),
    "fact_ptp_enriched": ("client_id", "payment_date"),
    "dim_cases": ("case_id", "client_id"),
}


def foreign_keys(m: Model) -> DataFrame:
    """Per relationship: non-null foreign keys with no dimension row.

    One pass for all relationships: every fact is read once and emits one
    (relationship, dimension, key) row per foreign key it carries; these
    are counted per key (partial aggregation: a hot key costs one row per
    task), matched once against the tagged union of all dimension keys and
    summed per relationship. One shuffle, however many relationships."""
    m = m.stored(REFERENCES, dim_date=dim_date(m))
    m = m.stored({}, operator_day=operator_day(m))

    # Keys are compared as bigint; dates as their day number.
    def as_key(c):
        return lambda df: (F.unix_date(col(c)) if dict(df.dtypes)[c] == "date" else col(c)).cast("bigint")

    calendar = m.dim_date
    checks = [(n, f, as_key(fk), d, as_key(pk)) for n, f, fk, d, pk in fk_checks(m)]
    checks += [(n, f, as_key(c), calendar, as_key("Date")) for n, f, c in fk_date_checks(m)]
    by_fact: dict[int, tuple[DataFrame, list]] = {}
    for name, fact, fk, dim, pk in checks:
        by_fact.setdefault(id(fact), (fact, []))[1].append((name, fk, dim, pk))
    dim_ids: dict[int, str] = {}
    dims_: list[tuple[str, DataFrame, object]] = []
    for _, _, _, dim, pk in checks:
        if id(dim) not in dim_ids:
            dim_ids[id(dim)] = f"d{len(dim_ids)}"
            dims_.append((dim_ids[id(dim)], dim, pk))

    streams = []
    for fact, rels in by_fact.values():
        arr = F.array(*[F.struct(F.lit(n).alias("rel"), F.lit(dim_ids[id(d)]).alias("dim"),
                                 fk(fact).alias("fk")) for n, fk, d, _ in rels])
        streams.append(fact.select(F.explode(arr).alias("_r")).select("_r.*"))
    refs = _union(streams).groupBy("rel", "dim", "fk").agg(F.count(F.lit(1)).alias("_n"))
    keys = _union([d.select(F.lit(tag).alias("_dim"), pk(d).alias("_key"))
                   for tag, d, pk in dims_]).where(col("_key").isNotNull()).distinct()
    j = refs.join(keys.withColumn("_hit", F.lit(1)),
                  (refs["dim"] == keys["_dim"]) & (refs["fk"] == keys["_key"]), "left")
    orphan = col("fk").isNotNull() & col("_hit").isNull()
    return (j.groupBy(col("rel").alias("relationship"))
             .agg(F.sum(F.when(orphan, col("_n")).otherwise(0)).cast("bigint").alias("orphan_rows")))


# DQ3
def fanout(m: Model) -> DataFrame:
    """Fact rows against the rows of the relation that defines the grain."""
    m = m.stored({n: KEYS[n][:1] for n in FACTS}, promises=promise_base(m.src, m.po).select("case_id"),
                 month_money=union_paid_unpaid(m.src, m.po).select("case_id"))
    pairs = [
        ("fact_dialer", dialer_base(m.src, m.pe), m.fact_dialer),
        ("fact_contacts", contact_base(m.src, m.pe), m.fact_contacts),
        ("fact_payments", m.src.payments, m.fact_payments),
        ("fact_ptp", m.promises, m.fact_ptp),
        ("fact_ptp_enriched", m.month_money, m.fact_ptp_enriched),
        ("cc_operator_activity", activity_counts(m.src, m.pe), m.cc_operator_activity),
        ("fact_operator_presence", cross_presence(m.src, m.pe), m.fact_operator_presence),
    ]
    parts = []
    for name, base, fact in pairs:
        b = base.agg(F.count(F.lit(1)).alias("base_rows"))
        f = fact.agg(F.count(F.lit(1)).alias("fact_rows"))
        parts.append(b.select(F.lit(name).alias("dataset"), "base_rows",
                              f.scalar().alias("fact_rows")))
    return _union(parts).withColumn("extra_rows", col("fact_rows") - col("base_rows"))


def fanout_plain(m: Model) -> DataFrame:
    """The source's plain provider join (one row per attribute row) against the grain: promises
    and cases with several attributes appear more than once."""
    plain = m.po.with_(provider_mode="join")
    kept = dim_cases(m.src, m.po)
    parts = []
    for name, base, fact in (("fact_ptp", promise_base(m.src, m.po), fact_ptp(m.src, plain)),
                             ("dim_cases", kept, dim_cases(m.src, plain))):
        both = base.select(F.lit(1).alias("b"), F.lit(0).alias("f")).unionByName(
            fact.select(F.lit(0).alias("b"), F.lit(1).alias("f")))
        parts.append(both.agg(F.sum("b").cast("bigint").alias("base_rows"), F.sum("f").cast("bigint").alias("fact_rows"))
                     .select(F.lit(name).alias("dataset"), "base_rows", "fact_rows"))
    return _union(parts).withColumn("extra_rows", col("fact_rows") - col("base_rows"))


def documented_keys(m: Model) -> DataFrame:
    """The keys that the documentation names, which the facts need not keep."""
    parts = []
    for name, df, keys in (
        ("fact_ptp", m.fact_ptp, [col("case_id"), col("contact_date"), col("operator_norm")]),
        ("fact_ptp_enriched", m.fact_ptp_enriched, [col("ref_number"), F.trunc("promise_date", "MM")]),
    ):
        null_part = F.lit(False)
        for k in keys:
            null_part = null_part | k.isNull()
        counts = df.groupBy(*[k.alias(f"k{n}") for n, k in enumerate(keys)], null_part.alias("no_key")).agg(
            F.count(F.lit(1)).alias("n"))
        parts.append(counts.agg(
            F.sum("n").cast("bigint").alias("row_count"),
            F.sum(F.when(col("no_key"), col("n")).otherwise(0)).cast("bigint").alias("null_keys"),
            F.sum(F.when(col("n") > 1, 1).otherwise(0)).cast("bigint").alias("duplicate_keys"),
            F.sum(F.when(col("n") > 1, col("n") - 1).otherwise(0)).cast("bigint").alias("surplus_rows"),
        ).select(F.lit(name).alias("dataset"), "row_count", "null_keys", "duplicate_keys", "surplus_rows"))
    return _union(parts)


# DQ4
#: Columns whose source values leave the set that the rules know.
SOURCE_DOMAINS = {
    ("dialer_calls", "disposition"): ("ANSWERED", "NO ANSWER", "FAILED"),
    ("ptp_overview", "state"): ("Active", "Expired", "Fulfilled", "Canceled"),
    ("contact_events", "target_type_id"): (1, 2, 3, 4, 5, 6),
}


def source_domains(m: Model) -> DataFrame:
    """Rows, nulls and values outside the known set, per checked column of the raw relations."""
    parts = []
    for (name, c), allowed in SOURCE_DOMAINS.items():
        parts.append(m.src.rel(name).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.when(col(c).isNull(), 1).otherwise(0)).cast("bigint").alias("null_rows"),
            F.sum(F.when(~col(c).isin(*allowed), 1).otherwise(0)).cast("bigint").alias("unknown_rows"),
        ).select(F.lit(f"{name}.{c}").alias("column_name"), "row_count", "null_rows", "unknown_rows"))
    return _union(parts)


DOMAINS = {
    ("fact_contacts", "contact_channel"): ("WhatsApp", "RCS", "SMS", "Email", "BOT", "Dialer", "Manual"),
    ("fact_ptp", "was_paid"): ("paid", "not paid"),
    ("fact_ptp_enriched", "ptp_status"): ("PAID", "OVERDUE", "DUE"),
    ("fact_ptp_enriched", "money_type"): ("NEW MONEY", "OLD MONEY"),
    ("fact_operator_presence", "attendance_status"): ("not_employed", "inactive", "training",
                                                      "present", "absent"),
}


def value_domains(m: Model) -> DataFrame:
    """Rows whose value is null or outside the allowed set, per column. Each
    dataset is read once, whatever the number of its checked columns."""
    m = m.stored({ds: [c for d, c in DOMAINS if d == ds] for ds, _ in DOMAINS})
    parts = []
    for ds in dict.fromkeys(d for d, _ in DOMAINS):
        columns = {c: allowed for (d, c), allowed in DOMAINS.items() if d == ds}
        counts = getattr(m, ds).agg(*[
            F.sum(F.when(col(c).isNull() | ~col(c).isin(*allowed), 1).otherwise(0)).cast("bigint").alias(c)
            for c, allowed in columns.items()])
        parts.append(counts.select(F.inline(F.array(*[
            F.struct(F.lit(f"{ds}.{c}").alias("column_name"), col(c).alias("bad_rows")) for c in columns]))))
    return _union(parts)


# DQ5
def flag_implications(m: Model) -> DataFrame:
    d = m.fact_dialer
    return d.agg(
        F.sum(F.when((col("cpc_flag") == 1) & (col("answered_flag") == 0), 1).otherwise(0))
        .cast("bigint").alias("cpc_not_answered"),
        F.sum(F.when((col("operator_not_connected_flag") == 1) & (col("answered_flag") == 0), 1)
              .otherwise(0)).cast("bigint").alias("not_connected_not_answered"),
        F.sum(F.when((col("cpc_flag") == 1) & (col("operator_not_connected_flag") == 1), 1)
              .otherwise(0)).cast("bigint").alias("cpc_and_not_connected"))


def cross_implications(m: Model) -> DataFrame:
    """Implications between facts, which the source may break: a contact with a campaign has a
    call with an operator; a call that counts as answered has a bridge row; money of a promise does not come
    before it."""
    c, d, e = m.fact_contacts, m.fact_dialer, m.fact_ptp_enriched
    checks = [
        ("contact_campaign_without_bridge", c, col("campaign_id").isNotNull(), col("dialer_contact_id").isNull()),
        ("answered_call_without_bridge", d, col("answered_flag") == 1, col("contact_id").isNull()),
        ("payment_before_promise", e, col("ptp_status") == "PAID", col("payment_date") < col("promise_date")),
    ]
    return _union([df.agg(F.count(F.when(given, 1)).alias("premise_rows"), F.count(F.when(given & broken, 1)).alias("broken_rows"))
                   .select(F.lit(name).alias("check_name"), "premise_rows", "broken_rows") for name, df, given, broken in checks])


# DQ6
def debtor_fanout(m: Model) -> DataFrame:
    """Rows that a join of cases by debtor would give for each fact, without the join: rows per
    debtor times cases per debtor. Facts are counted per case first, so the largest debtor
    costs one row per case and fact."""
    def of(name, df):
        return df.where(col("case_id").isNotNull()).groupBy(col("case_id").cast("bigint").alias("case_id")).agg(
            F.count(F.lit(1)).alias("n")).withColumn("fact", F.lit(name))

    counts = _union([of(n, f) for n, f in (("fact_dialer", m.fact_dialer), ("fact_contacts", m.fact_contacts),
                                           ("fact_ptp", m.fact_ptp), ("fact_payments", m.fact_payments))])
    owner = m.src.cases.where(col("debtor_id").isNotNull()).select(col("case_id").cast("bigint").alias("case_id"), "debtor_id")
    degree = owner.groupBy("debtor_id").agg(F.count(F.lit(1)).alias("cases"))
    held = counts.join(owner, "case_id").groupBy("fact", "debtor_id").agg(F.sum("n").alias("n")).join(degree, "debtor_id")
    return held.groupBy("fact").agg(
        F.sum("n").cast("bigint").alias("fact_rows"), F.sum(col("n") * col("cases")).cast("bigint").alias("joined_rows"),
        F.max(col("n") * col("cases")).cast("bigint").alias("largest_debtor"))


def debtor_many_cases(m: Model) -> DataFrame:
    """Debtors holding more than one case (the many-to-many trap)."""
    return (m.src.cases.where(col("debtor_id").isNotNull())
            .groupBy("debtor_id").agg(F.count(F.lit(1)).alias("cases"))
            .where(col("cases") > 1))


# DQ7
def presence_completeness(m: Model) -> DataFrame:
    p = m.pe
    n_days = sum(1 for i in range((p.as_of - p.calendar_start).days + 1)
                 if (p.calendar_start + dt.timedelta(days=i)).weekday() < 5)
    ops = m.dim_operators.where(col("is_operator") == "Yes").agg(F.count(F.lit(1)).alias("operators"))
    rows = m.fact_operator_presence.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ops.select("operators", F.lit(n_days).cast("bigint").alias("business_days"),
                      (col("operators") * n_days).alias("expected_rows"),
                      rows.alias("actual_rows"))


def presence_gaps(m: Model, presence: DataFrame | None = None) -> DataFrame:
    """Grid days that a presence table lacks, per operator."""
    p = m.pe
    have = (m.fact_operator_presence if presence is None else presence).select("users_id", "WorkDate")
    grid = cross_presence(m.src, p)
    return (grid.join(have.distinct(), ["users_id", "WorkDate"], "left_anti").groupBy("users_id")
            .agg(F.count(F.lit(1)).alias("missing_days"), F.min("WorkDate").alias("first_missing")))


def presence_gaps_planted(m: Model) -> DataFrame:
    """The check over a presence table from which a fifth of the days was taken."""
    held = (col("users_id") + F.datediff("WorkDate", F.lit(m.pe.calendar_start))) % 5 != 0
    return presence_gaps(m, m.fact_operator_presence.where(held))


# DQ8
def client_ids(m: Model) -> DataFrame:
    """Per fact: rows on the reserved client ids (1, 999) and rows whose
    client is not in the client table. Facts are counted per client first;
    the counts meet the client table in one join."""
    m = m.stored({n: ("client_id",) for n in ("fact_dialer", "fact_contacts", "fact_ptp", "fact_ptp_enriched", "fact_payments")})
    facts_ = [("fact_dialer", m.fact_dialer), ("fact_contacts", m.fact_contacts),
              ("fact_ptp", m.fact_ptp), ("fact_ptp_enriched", m.fact_ptp_enriched),
              ("fact_payments", m.fact_payments)]
    counts = _union([f.groupBy(col("client_id").cast("bigint").alias("cid")).agg(F.count(F.lit(1)).alias("_n"))
                     .withColumn("dataset", F.lit(name)) for name, f in facts_])
    clients = m.src.client.select(col("client_id").cast("bigint").alias("_c"), F.lit(1).alias("_known")).distinct()
    j = counts.join(clients, counts["cid"] == clients["_c"], "left")
    reserved, unknown = col("cid").isin(1, 999), col("cid").isNotNull() & col("_known").isNull()
    return j.groupBy("dataset").agg(
        F.sum(F.when(reserved, col("_n")).otherwise(0)).cast("bigint").alias("reserved_rows"),
        F.sum(F.when(unknown, col("_n")).otherwise(0)).cast("bigint").alias("unknown_client_rows"))
