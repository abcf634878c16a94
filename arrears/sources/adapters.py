"""Driver tables -> domain relations.

The driver ships TPC-H-like tables plus an ``events`` stream. Each domain
relation the plans read (calls, contacts, promises, ...) is derived from
them by the column expressions below. The expressions are plain SQL that
both Spark and DuckDB accept, so the Spark side (``selectExpr``) and the
SQL oracle build *identical* inputs; only the plans under test differ.
These mappings are test fixtures, not business rules.
"""

from __future__ import annotations

from dataclasses import dataclass

# Base row sets an adapter part can start from: tables and equi-join keys.
BASES: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    "region": (("region",), ()),
    "nation": (("nation",), ()),
    "customer": (("customer",), ()),
    "supplier": (("supplier",), ()),
    "events": (("events",), ()),
    "orders": (("orders",), ()),
    "orders_customer": (("orders", "customer"), (("o_custkey", "c_custkey"),)),
    "lineitem_orders_customer": (("lineitem", "orders", "customer"),
                                 (("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"))),
}


@dataclass(frozen=True)
class Part:
    base: str
    where: str | None
    columns: tuple[tuple[str, str], ...]


def _p(base, where, *cols):
    return Part(base, where, tuple(cols))


_SUPPLIER_LOGIN = "concat(' Supplier#', lpad(cast(o_orderkey % 12 as string), 9, '0'), ' ')"


def _calls(uniqueid: str, at: str, campaign: int) -> tuple[tuple[str, str], ...]:
    return (("uniqueid", uniqueid),
            ("queue_item_id", "event_id % 1000"),
            ("disposition_code", "event_id % 6"),
            ("campaign_id", f"{campaign} + event_id % 11"),
            ("campaign_name", f"concat('Campaign_', cast({campaign} + event_id % 11 as string))"),
            ("case_id", "user_id"),
            ("debtor_id", "user_id % 700"),
            ("telecom_id", "user_id"),
            ("client_id", "user_id % 25"),
            ("phone_number", "concat('55', cast(11 + user_id % 89 as string), '900000000')"),
            ("call_date", at),
            ("duration", "case when event_id % 41 = 0 then null else cast(floor(value) as int) + 10 end"),
            ("billsec", "case when event_id % 37 = 0 then null else cast(floor(value) as int) end"),
            ("disposition", "case event_id % 4 when 0 then 'ANSWERED' when 1 then 'NO ANSWER' "
                            "when 2 then 'BUSY' else 'FAILED' end"),
            ("hangup_cause", "case when event_id % 2 = 0 then 'NORMAL_CLEARING' else 'USER_BUSY' end"))


ADAPTERS: dict[str, tuple[Part, ...]] = {
    "company": (_p("region", None,
                   ("company_id", "r_regionkey"),
                   ("company_name", "r_name")),),
    "client": (_p("nation", None,
                  ("client_id", "n_nationkey"),
                  ("company_id", "n_regionkey")),),
    "dim_commission_rules": (_p("nation", None,
                                ("client_id", "n_nationkey"),
                                ("commission_rate", "cast(5 + n_nationkey % 5 as double) / 100")),),
    "cases": (_p("customer", None,
                 ("case_id", "c_custkey"),
                 ("client_id", "c_nationkey"),
                 ("debtor_id", "c_custkey % 700"),
                 ("ref_number", "concat('REF', cast(c_custkey as string))"),
                 ("client_ref_number", "concat('CREF', cast(c_custkey as string))"),
                 ("case_status_id", "c_custkey % 3"),
                 ("original_capital", "c_acctbal + 1000"),
                 ("actual_capital", "c_acctbal"),
                 ("department_id", "1 + c_custkey % 5"),
                 ("currency_id", "1"),
                 ("insert_date", "DATE '2001-01-01' - cast(c_custkey % 300 as int)"),
                 ("update_date", "DATE '2001-07-15' - cast(c_custkey % 120 as int)"),
                 ("dpd_original", "c_custkey % 720")),),
    "cases_information": (_p("customer", None,
                             ("case_id", "c_custkey"),
                             ("dpd_original", "c_custkey % 720"),
                             ("original_capital", "c_acctbal + 1000"),
                             ("actual_capital", "c_acctbal"),
                             ("case_statute_id", "c_custkey % 4")),),
    "case_attributes": (
        _p("customer", None,
           ("case_id", "c_custkey"),
           ("attribute_type", "303"),
           ("attribute_value", "concat(' ', c_mktsegment, ' ')")),
        _p("customer", "c_custkey % 10 = 0",
           ("case_id", "c_custkey"),
           ("attribute_type", "303"),
           ("attribute_value", "'ZETA'")),
        _p("customer", None,
           ("case_id", "c_custkey"),
           ("attribute_type", "100"),
           ("attribute_value", "c_name")),
    ),
    "users": (_p("supplier", None,
                 ("user_id", "s_suppkey"),
                 ("user_name", "lower(s_name)"),
                 ("full_name", "s_name"),
                 ("user_status", "case when s_suppkey % 5 = 0 then 0 else 1 end"),
                 ("sip_account", "case when s_suppkey % 10 = 9 then 'n/a' when s_suppkey % 10 = 8 then null "
                                 "when s_suppkey % 20 = 7 then '199.5' when s_suppkey % 20 = 17 then '200.0' "
                                 "else cast(195 + s_suppkey as string) end"),
                 ("insert_date", "DATE '2024-01-01' + cast(s_suppkey % 20 as int)"),
                 ("update_date", "case when s_suppkey % 4 = 0 then null "
                                 "else DATE '2024-01-31' - cast(s_suppkey % 7 as int) end")),),
    "contact_events": (_p("events", "event_type <> 'view'",
                          ("contact_id", "event_id"),
                          ("case_id", "user_id"),
                          ("telecom_id", "user_id"),
                          ("contact_date", "ts"),
                          ("description", "case when event_id % 11 = 0 then 'bot attempt' else 'manual' end"),
                          ("status_type_id", "case event_id % 9 when 0 then 2 when 1 then 8 when 2 then 48 "
                                             "when 3 then 118 when 4 then 119 when 5 then 120 when 6 then 300 "
                                             "when 7 then 15 else null end"),
                          ("target_type_id", "event_id % 7"),
                          ("contact_text", "case cast(regexp_extract(props, '[0-9]+', 0) as int) % 7 "
                                           "when 0 then 'WhatsApp contact' when 1 then 'rcs message' "
                                           "when 2 then 'SMS sent' when 3 then 'email sent' "
                                           "when 4 then 'bot attempt' when 5 then 'Manual follow up' "
                                           "else 'Negotiation call' end"),
                          ("insert_user", "case when event_id % 50 = 1 then 'system_user' else "
                                          "concat(' Supplier#', lpad(cast(user_id % 120 as string), 9, '0')) end")),),
    # A second call follows four minutes after each first one.
    "dialer_calls": (_p("events", "event_type = 'view'", *_calls("event_id", "ts", 100)),
                     _p("events", "event_type = 'view'",
                        *_calls("-event_id - 1", "ts + INTERVAL '4' MINUTE", 200))),
    "dialer_contact": (
        # Every eighth row names a call that does not exist.
        _p("events", "event_type = 'view'",
           ("unique_id", "case when event_id % 8 = 0 then -1000000000 - event_id else event_id end"),
           ("sip_account", "case when event_id % 6 = 0 then null else cast(195 + user_id % 20 as string) end"),
           ("contact_id", "event_id + 1"),
           ("call_date", "ts")),
        _p("events", "event_type = 'view' and event_id % 5 = 0",
           ("unique_id", "event_id"),
           ("sip_account", "'200'"),
           ("contact_id", "cast(null as bigint)"),
           ("call_date", "ts - INTERVAL '10' SECOND")),
    ),
    "ptp_overview": (_p("orders_customer", None,
                        ("ptp_id", "o_orderkey"),
                        ("case_id", "o_custkey"),
                        ("client_id", "c_nationkey"),
                        ("ref_number", "concat('REF', cast(o_custkey as string))"),
                        ("client_ref_number", "concat('CREF', cast(o_custkey as string))"),
                        ("operator", _SUPPLIER_LOGIN),
                        ("contact_id", "case when o_orderkey % 10 = 0 then null "
                                       "else cast(floor(o_orderkey / 3) as bigint) end"),
                        ("type", "case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Installment' "
                                 "else 'Single' end"),
                        ("payment_number", "1 + o_orderkey % 6"),
                        ("number_of_installments", "1 + o_orderkey % 12"),
                        ("contact_date", "o_orderdate - INTERVAL '10' DAY"),
                        ("promise_date", "cast(o_orderdate as date)"),
                        ("last_payment_date", "case when o_orderstatus = 'F' then "
                                              "cast(o_orderdate + INTERVAL '3' DAY as date) else null end"),
                        ("promise_capital", "o_totalprice"),
                        ("promise_capital_total", "o_totalprice"),
                        ("paid", "case when o_orderstatus = 'F' then o_totalprice else 0.0 end"),
                        ("dpd", "o_orderkey % 400"),
                        ("phone_number", "concat('55', cast(11 + o_custkey % 89 as string), '900000000')"),
                        ("contact_attribute", "case o_orderkey % 4 when 0 then 'NULL' when 1 then null "
                                              "when 2 then 'Inbound' else 'WhatsApp' end"),
                        ("state", "case when o_orderkey % 13 = 0 then null when o_orderstatus = 'O' then 'Active' "
                                  "when o_orderstatus = 'P' then 'Expired' else 'Fulfilled' end")),),
    "payments": (_p("lineitem_orders_customer", None,
                    ("payment_id", "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', "
                                   "cast(l_partkey as string), '-', cast(l_suppkey as string))"),
                    ("ref_number", "concat('REF', cast(o_custkey as string))"),
                    ("case_id", "o_custkey"),
                    ("client_id", "c_nationkey"),
                    ("payment_date", "cast(l_shipdate as date)"),
                    ("payed_capital", "l_extendedprice"),
                    ("payed_plus_money", "l_extendedprice * l_tax"),
                    ("payed_administrative_assessment", "l_extendedprice * 0.02"),
                    ("payed_delay_charge", "l_extendedprice * l_discount")),),
    # Every third order was noted by an operator who made no promise of it.
    "promises_information": (_p("orders", None,
                                ("case_id", "o_custkey"),
                                ("contact_date", "o_orderdate - INTERVAL '10' DAY"),
                                ("operator", f"case when o_orderkey % 3 = 0 then ' Supplier#other ' else {_SUPPLIER_LOGIN} end"),
                                ("contact_time", "concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', "
                                                 "lpad(cast(o_orderkey % 60 as string), 2, '0'), ':00')")),),
    # Every fourth instalment was entered a day after the contact.
    "installment": (_p("orders", None,
                       ("installment_id", "o_orderkey"),
                       ("case_id", "o_custkey"),
                       ("ref_number", "concat('REF', cast(o_custkey as string))"),
                       ("insert_date", "case when o_orderkey % 4 = 0 then o_orderdate - INTERVAL '9' DAY "
                                       "else o_orderdate - INTERVAL '10' DAY end + INTERVAL '9' HOUR"),
                       ("amount", "o_totalprice")),),
}

RELATIONS = tuple(ADAPTERS)


def _from_sql(base: str) -> str:
    tables, keys = BASES[base]
    sql = tables[0]
    for t, (lk, rk) in zip(tables[1:], keys):
        sql += f" JOIN {t} ON {lk} = {rk}"
    return sql


def relation_sql(name: str) -> str:
    """SQL (DuckDB / Spark SQL) text that builds one domain relation."""
    parts = []
    for part in ADAPTERS[name]:
        cols = ", ".join(f"{expr} AS {col}" for col, expr in part.columns)
        where = f" WHERE {part.where}" if part.where else ""
        parts.append(f"SELECT {cols} FROM {_from_sql(part.base)}{where}")
    return "\nUNION ALL\n".join(parts)


def build_relation(read_table, name: str):
    """Spark DataFrame for one domain relation.

    ``read_table(table_name) -> DataFrame`` reads a driver table. Columns not
    referenced are pruned by Catalyst before the scan. The inner joins are built from the last
    table: the rows of the first and largest one then move once, not once per key.
    """
    out = None
    for part in ADAPTERS[name]:
        tables, keys = BASES[part.base]
        df = read_table(tables[-1])
        for t, (lk, rk) in zip(tables[-2::-1], keys[::-1]):
            left = read_table(t)
            df = left.join(df, left[lk] == df[rk])
        if part.where:
            df = df.where(part.where)
        df = df.selectExpr(*[f"{expr} AS {col}" for col, expr in part.columns])
        out = df if out is None else out.unionByName(df)
    return out
