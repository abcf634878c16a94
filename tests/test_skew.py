"""Facts on a planted data set with one hot key (a third of all rows),
exact window edges, equal timestamps, duplicate bridge rows and same-day
payments, compared with the SQL oracle run on the same rows."""

import datetime as dt
import random

import duckdb
import pytest

from arrears.checks import oracle as Q
from arrears.checks import oracle_reports  # noqa: F401  (registers CTEs)
from arrears.checks.compare import compare
from arrears.sources.driver_dates import events_params, orders_params
from arrears.plans import facts
from arrears.sources.adapters import RELATIONS
from util import RowSources

R = random.Random(11)
E0 = dt.datetime(2024, 1, 1)


def _hot(n_keys):
    return 1 if R.random() < 0.34 else R.randrange(2, n_keys)


def _ts():
    # 5-minute grid over 30 days: many equal timestamps and exact +-15 min pairs
    return E0 + dt.timedelta(minutes=5 * R.randrange(0, 30 * 24 * 12))


def planted():
    users = [(u, f"op{u}", f"Op {u}", u % 2, str(195 + u) if u % 7 else None,
              dt.date(2024, 1, 1 + u % 10), None if u % 3 else dt.date(2024, 1, 25)) for u in range(1, 13)]
    contacts, calls, bridge = [], [], []
    for i in range(1500):
        k = _hot(40)
        contacts.append((i, k, k, _ts(), "bot" if i % 9 == 0 else "manual", (2, 8, 48, 118, None)[i % 5],
                         i % 7, ("whats", "sms", "call", None)[i % 4], f" OP{i % 14} " if i % 31 else "system_user"))
    for i in range(2500):
        k = _hot(40)
        t = _ts()
        calls.append((10_000 + i, i % 50, i % 6, 100 + i % 4, f"C{i % 4}", k, k % 7, k, k % 5,
                      f"55{11 + k % 80}900000000", t, (None, 30, 5)[i % 3], (0, 3, 4, 40, None)[i % 5],
                      "ANSWERED", "N"))
        if i % 6:
            bridge.append((10_000 + i, str(195 + i % 12) if i % 4 else None, 50_000 + i, t))
        if i % 5 == 0:     # duplicate bridge row, sometimes at the same instant
            bridge.append((10_000 + i, "200", None, t if i % 10 == 0 else t - dt.timedelta(seconds=10)))
    O0 = dt.datetime(2001, 6, 1)
    ptp, pays = [], []
    for i in range(900):
        c = _hot(60)
        od = O0 + dt.timedelta(days=R.randrange(0, 61))
        ptp.append((i, c, c % 5, f"REF{c}", f"CREF{c}", f" Op {i % 13} ", i if i % 4 else None,
                    "Installment" if i % 3 == 0 else "Single", 1 + i % 4, 1 + i % 6,
                    od - dt.timedelta(days=R.randrange(0, 5)), od.date(),
                    (od + dt.timedelta(days=3)).date() if i % 2 else None,
                    float(100 + i % 7), float(100 + i % 5), float(i % 3) * 10.0, i % 400 - 5,
                    f"55{11 + i % 89}9", (None, "NULL", "Inbound")[i % 3],
                    ("Active", "Expired", None, "Fulfilled")[i % 4]))
    for i in range(2500):
        c = _hot(60)
        if c % 4 == 0:          # these refs never pay: unpaid promises
            continue
        lo = 30 if c % 4 == 1 else 0   # these pay only from July: NEW money first
        d = (O0 + dt.timedelta(days=R.randrange(lo, 61))).date()
        pays.append((f"P{i}", f"REF{c}", c, c % 5, d, float(10 + i % 9), 1.0, 0.5, 0.25))
    cases = [(c, c % 5, c % 7, f"REF{c}", f"CREF{c}", c % 3, 10.0 * c, 5.0 * c, 1, 1,
              dt.date(2001, 1, 1), dt.date(2001, 7, 1 + c % 10), c % 400) for c in range(1, 60)]
    attrs = [(c, 303, f" P{c % 3} ") for c in range(1, 60)] + [(c, 303, "Z") for c in range(1, 60, 4)]
    prom_info = [(r[1], r[10], r[5], f"{i % 24:02d}:{i % 60:02d}:00") for i, r in enumerate(ptp) if i % 2]
    inst = [(i, r[1], r[3], r[10] + dt.timedelta(hours=9), 1.0) for i, r in enumerate(ptp) if i % 3]
    return {
        "users": users, "contact_events": contacts, "dialer_calls": calls, "dialer_contact": bridge,
        "ptp_overview": ptp, "payments": pays, "cases": cases, "case_attributes": attrs,
        "promises_information": prom_info, "installment": inst,
        "cases_information": [(c, c % 400, 10.0 * c, 5.0 * c, c % 4) for c in range(1, 60)],
        "client": [(k, k % 3) for k in range(5)], "company": [(k, f"Co{k}") for k in range(3)],
        "dim_commission_rules": [(k, 0.05) for k in range(5)],
    }


@pytest.fixture(scope="module")
def planted_env(spark):
    src = RowSources(spark, planted())
    con = duckdb.connect()
    for name in RELATIONS:
        con.register(name, src.rel(name).toArrow())
    return src, con


@pytest.mark.parametrize("name,fn,params", [
    ("fact_dialer", facts.fact_dialer, events_params),
    ("fact_contacts", facts.fact_contacts, events_params),
    ("cc_operator_activity", facts.cc_operator_activity, events_params),
    ("fact_operator_presence", facts.fact_operator_presence, events_params),
    ("fact_ptp", facts.fact_ptp, orders_params),
    ("fact_ptp_enriched", facts.fact_ptp_enriched, orders_params),
    ("fact_payments", facts.fact_payments, orders_params),
    ("view_interval_join_15m", None, events_params),
])
def test_fact_on_skewed_rows(planted_env, name, fn, params):
    src, con = planted_env
    if fn is None:
        from arrears.plans.views import interval_join_15m as fn
    df = fn(src, params())
    r = compare(df, con, Q.sql(f"SELECT * FROM {name}", name, skip=RELATIONS))
    assert r["ok"], r
    assert r["rows_spark"] > 0


from arrears.registry import MODEL_REPORTS  # noqa: E402


@pytest.mark.parametrize("name", sorted(MODEL_REPORTS))
def test_report_on_skewed_rows(planted_env, name):
    from arrears.plans.model import Model
    src, con = planted_env
    fn, cte_name = MODEL_REPORTS[name]
    r = compare(fn(Model(src, events_params(), orders_params())), con, Q.sql(f"SELECT * FROM {cte_name}", cte_name, skip=RELATIONS))
    assert r["ok"], r
