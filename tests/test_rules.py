"""Planted rows for rules the driver data cannot reach."""

import datetime as dt

from pyspark.sql import functions as F

from arrears.config import Params
from arrears.sources.driver_dates import events_params, orders_params
from arrears.functions import classify as K
from arrears.plans import dims, facts
from util import RowSources

D = dt.date
TS = dt.datetime


def _eval(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_call_flags(spark):
    rows = [(b, s) for b in (0, 1, 3, 4, 39, 40, None) for s in ("201", None)]
    got = _eval(spark, rows, "billsec int, sip string",
                K.answered_flag(F.col("billsec")), K.operator_not_connected_flag(F.col("billsec"), F.col("sip")),
                K.cpc_flag(F.col("billsec"), F.col("sip")), K.dialer_state(F.col("billsec"), F.col("sip")))
    want = []
    for b, s in rows:
        v = b or 0
        state = ("NO_ANSWER" if v == 0 else "NO_OPERATOR" if v > 3 and s is None
                 else "HUMAN (CPC)" if v >= 40 and s is not None else "OTHER")
        want.append((int(v > 0), int(v > 3 and s is None), int(v >= 40 and s is not None), state))
    assert got == want


def test_dpd_bands_and_paid(spark):
    rows = [(-1,), (None,), (0,), (15,), (16,), (180,), (181,), (360,), (361,)]
    got = [r[0] for r in _eval(spark, rows, "dpd int", K.dpd_range(F.col("dpd")))]
    assert got == ["DPD 360+", "DPD 360+", "DPD 0-15", "DPD 0-15", "DPD 16-30", "DPD 121-180",
                   "DPD 181-360", "DPD 181-360", "DPD 360+"]
    paid = [r[0] for r in _eval(spark, [(0.0,), (None,), (5.0,)], "p double", K.was_paid(F.col("p")))]
    assert paid == ["not paid", "paid", "paid"]


def test_status_label_and_channel(spark):
    rows = [(None, "whats and sms", "x", None), (2, "SMS only", "bot", 5), (8, None, "VirtualBot", None),
            (300, "nothing", "x", 7), (15, None, None, None)]
    got = _eval(spark, rows, "st int, text string, descr string, camp int",
                K.status_label(F.col("st")),
                K.contact_channel(F.col("text"), F.col("descr"), F.col("camp")))
    assert got == [("Status_", "WhatsApp"), ("Agreement", "SMS"), ("No Interaction", "BOT"),
                   ("Agreement", "Dialer"), ("Status_15", "Manual")]


def test_operator_flags(spark):
    rows = [("abc", 1), ("199", 0), ("200", None), (None, 2), (" 201 ", 1)]
    df = spark.createDataFrame(rows, "sip string, status int")
    from arrears.functions.text import try_int
    got = [tuple(r) for r in df.select(try_int("sip"), K.is_operator(try_int("sip")),
                                       K.is_operator(try_int("sip"), strict=True),
                                       K.is_inactive(F.col("status"))).collect()]
    assert got == [(None, "Yes", "No", "No"), (199, "No", "No", "Yes"), (200, "Yes", "Yes", "Yes"),
                   (None, "Yes", "No", "Yes"), (201, "Yes", "Yes", "No")]


def test_attendance_rules(spark):
    # hire on Saturday 2024-01-06; leaving date 2024-01-10; null hire date
    rows = [(D(2024, 1, 5), D(2024, 1, 6), D(2024, 1, 10), None),
            (D(2024, 1, 8), D(2024, 1, 6), D(2024, 1, 10), None),       # hire + 2 days
            (D(2024, 1, 9), D(2024, 1, 6), D(2024, 1, 10), 3),
            (D(2024, 1, 9), D(2024, 1, 6), D(2024, 1, 10), 0),
            (D(2024, 1, 10), D(2024, 1, 6), D(2024, 1, 10), 4),          # WorkDate = end
            (D(2024, 1, 5), D(2024, 1, 4), D(2024, 1, 10), None),        # training
            (D(2024, 1, 5), None, D(2024, 1, 10), 1)]
    got = [r[0] for r in _eval(spark, rows, "w date, s date, e date, a bigint",
                               K.attendance_status(F.col("w"), F.col("s"), F.col("e"), F.col("a")))]
    assert got == ["not_employed", "absent", "present", "absent", "inactive", "training", None]


def test_contact_match_and_promise_dedup(spark):
    """Fact-level: latest call within +-15 min (may be later than the
    contact), bridge contact id, latest promise per contact."""
    t = TS(2024, 1, 20, 10, 0, 0)
    src = RowSources(spark, {
        "contact_events": [(1, 5, 5, t, "manual", 2, 1, "whatsapp hi", " Alice "),
                           (2, 5, 5, t, "manual", 2, 1, "x", "system_user"),
                           (3, 6, 6, None, "manual", None, 3, "sms", None)],
        "dialer_calls": [(100, 1, 1, 10, "C10", 5, 5, 5, 1, "5511900000000", t - dt.timedelta(minutes=14),
                          20, 20, "ANSWERED", "N"),
                         (101, 1, 1, 11, "C11", 5, 5, 5, 1, "5511900000000", t + dt.timedelta(minutes=15),
                          30, 30, "ANSWERED", "N")],
        "dialer_contact": [(101, "201", 7001, t), (101, "202", 7002, t - dt.timedelta(seconds=10))],
        "ptp_overview": [(1, 5, 1, "REF5", "CREF5", "x", 1, "Single", 1, 1, t, D(2024, 1, 25), None,
                          10.0, 10.0, 0.0, 1, "5511", None, "Active"),
                         (2, 5, 1, "REF5", "CREF5", "x", 1, "Single", 1, 1, t, D(2024, 1, 28), None,
                          20.0, 20.0, 0.0, 1, "5511", None, "Active")],
        "users": [(9, "alice", "Alice A", 1, "201", D(2024, 1, 1), None)],
        "cases": [(5, 3, 1, "REF5", "CREF5", 1, 1.0, 1.0, 1, 1, D(2024, 1, 1), D(2024, 1, 1), 0)],
    })
    rows = {r.contact_id: r for r in facts.fact_contacts(src, events_params()).collect()}
    assert set(rows) == {1}                      # system_user dropped, null date dropped
    r = rows[1]
    assert (r.campaign_id, r.dialer_contact_id, r.contact_channel) == (11, 7001, "WhatsApp")
    assert (r.operator_id, r.client_id, r.promise_capital, r.has_promise) == (9, 3, 20.0, 1)
    assert (r.is_cpc, r.is_rpc, r.status_label, r.contact_hour) == (1, 1, "Agreement", 10)


def test_dims_reserved_clients_and_providers(spark):
    src = RowSources(spark, {
        "company": [(1, "A"), (2, "B"), (3, "lonely")],
        "client": [(1, 1), (999, 1), (5, 2), (6, 77)],
        "cases": [(10, 5, 1, "R", "C", 0, 1.0, 1.0, 1, 1, D(2001, 1, 1), D(2001, 1, 1), 0),
                  (11, 5, 1, "R", "C", 0, 1.0, 1.0, 1, 1, D(2001, 1, 1), D(2001, 1, 1), 0)],
        "case_attributes": [(10, 303, "B"), (10, 303, "A"), (10, 100, "Z")],
    })
    comp = sorted(tuple(r) for r in dims.dim_company(src).collect())
    assert comp == [(2, "B", 5)]
    cl = sorted(tuple(r) for r in dims.dim_client(src).collect())
    assert cl == [(1, 1, "A"), (5, 2, "B"), (6, None, None), (999, 1, "A")]
    p = events_params()
    got = sorted((r.case_id, r.provider) for r in dims.dim_cases(src, p.with_(as_of=D(2001, 7, 15))).collect())
    assert got == [(10, "B"), (11, None)]
    joined = sorted((r.case_id, r.provider or "")
                    for r in dims.dim_cases(src, p.with_(as_of=D(2001, 7, 15), provider_mode="join")).collect())
    assert joined == [(10, "A"), (10, "B"), (11, "")]


def test_listings_are_ordered(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    rows = E.queries()["sorted_fact_operator_presence"](spark, SF_SMALL).collect()
    keys = [(r.WorkDate, r.full_name) for r in rows]
    assert keys == sorted(keys, key=lambda k: (-k[0].toordinal(), k[1]))
    rows = E.queries()["sorted_fact_dialer"](spark, SF_SMALL).collect()
    ts = [r.call_datetime for r in rows]
    assert ts == sorted(ts, reverse=True)


def test_shared_sip_fans_out_and_area_codes(spark):
    t = TS(2024, 1, 20, 10, 0, 0)
    src = RowSources(spark, {
        "dialer_calls": [(1, 1, 1, 10, "C", 5, 5, 5, 1, "5511900000000", t, 50, 50, "ANSWERED", "N")],
        "dialer_contact": [(1, "201", 9, t)],
        "users": [(7, "a", "A", 1, "201", D(2024, 1, 1), None), (8, "b", "B", 1, "201", D(2024, 1, 1), None)],
    })
    rows = facts.fact_dialer(src, events_params()).collect()
    assert sorted(r.operator_id for r in rows) == [7, 8]          # kept; DQ reports it
    assert all(r.cpc_flag == 1 and r.answered_flag == 1 for r in rows)
    phones = [("5511999",), ("5520999",), ("55",), (None,)]
    df = spark.createDataFrame(phones, "phone string").select(K.area_code(F.col("phone")).alias("ddd"))
    from arrears.operators.lookup import ddd_map
    m = ddd_map(spark)
    got = [(r.ddd, r.uf) for r in df.join(m, "ddd", "left").collect()]
    assert sorted(got, key=repr) == sorted([("11", "São Paulo"), ("20", None), ("", None), (None, None)],
                                           key=repr)


def test_null_state_is_not_an_open_promise(spark):
    t = TS(2001, 7, 1)
    row = lambda i, state: (i, i, 1, f"REF{i}", "C", "op", i, "Single", 1, 1, t, D(2001, 7, 20), None,
                            5.0, 5.0, 0.0, 1, "5511", None, state)
    src = RowSources(spark, {"ptp_overview": [row(1, None), row(2, "Active"), row(3, "Expired")]})
    got = sorted(r.case_id for r in facts.ptp_without_payment(src, Params(as_of=D(2001, 7, 15))).collect())
    assert got == [2]          # NOT IN drops the null state as well as closed ones


def test_documented_rule_options(spark):
    # inactive needs user_status <> 1 when asked
    rows = [(D(2024, 1, 12), D(2024, 1, 2), D(2024, 1, 10), 3, 1),
            (D(2024, 1, 12), D(2024, 1, 2), D(2024, 1, 10), 3, 0)]
    df = spark.createDataFrame(rows, "w date, s date, e date, a bigint, st int")
    code = [r[0] for r in df.select(K.attendance_status(F.col("w"), F.col("s"), F.col("e"), F.col("a"))).collect()]
    doc = [r[0] for r in df.select(K.attendance_status(F.col("w"), F.col("s"), F.col("e"), F.col("a"),
                                                       user_status=F.col("st"))).collect()]
    assert code == ["inactive", "inactive"] and doc == ["present", "inactive"]
    # OLD money within 30 days vs since the first day of last month
    t = TS(2001, 7, 1)
    ptp = [(1, 5, 1, "REF5", "C", "op", 1, "Single", 1, 1, t, D(2001, 7, 20), None,
            5.0, 5.0, 0.0, 1, "5511", None, "Active")]
    pays = [("a", "REF5", 5, 1, D(2001, 6, 2), 1.0, 0.0, 0.0, 0.0),
            ("b", "REF5", 5, 1, D(2001, 7, 10), 1.0, 0.0, 0.0, 0.0)]
    src = RowSources(spark, {"ptp_overview": ptp, "payments": pays})
    p = Params(as_of=D(2001, 7, 15))
    by_mode = {}
    for mode in ("prev_month", "30d"):
        rows = facts.fact_ptp_enriched(src, p.with_(old_money_window=mode)).collect()
        by_mode[mode] = {r.payment_id: r.money_type for r in rows}
    assert by_mode == {"prev_month": {"b": "OLD MONEY"}, "30d": {"b": "NEW MONEY"}}
