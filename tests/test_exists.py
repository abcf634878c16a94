"""Previous-payment (EXISTS) flags against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from arrears.operators.exists import earlier_in_window, flag_if_exists, keys_with_rows, without_match


def month_start_prev(d):
    m = d.replace(day=1)
    return (m - dt.timedelta(days=1)).replace(day=1)


def test_earlier_in_window_matches_brute_force(spark):
    rnd = random.Random(7)
    base = dt.date(2001, 5, 20)
    rows = []
    for i in range(400):
        ref = "R1" if rnd.random() < 0.35 else f"R{rnd.randrange(2, 30)}"
        rows.append((f"p{i}", ref, base + dt.timedelta(days=rnd.randrange(0, 75))))
    # planted: same day twice, first day of the previous month, the day before it
    rows += [("x1", "RX", dt.date(2001, 7, 10)), ("x2", "RX", dt.date(2001, 7, 10)),
             ("y1", "RY", dt.date(2001, 6, 1)), ("y2", "RY", dt.date(2001, 7, 3)),
             ("z1", "RZ", dt.date(2001, 5, 31)), ("z2", "RZ", dt.date(2001, 7, 3))]
    df = spark.createDataFrame(rows, "payment_id string, ref_number string, payment_date date")
    flags = earlier_in_window(df, "ref_number", "payment_date",
                              F.add_months(F.trunc("payment_date", "MM"), -1))
    got = {(r.ref_number, r.payment_date): r.has_previous_payment for r in flags.collect()}
    want = {}
    for _, ref, d in rows:
        lo = month_start_prev(d)
        want[(ref, d)] = int(any(r2 == ref and lo <= d2 < d for _, r2, d2 in rows))
    assert got == want
    assert got[("RX", dt.date(2001, 7, 10))] == 0      # same day is not earlier
    assert got[("RY", dt.date(2001, 7, 3))] == 1       # first of previous month counts
    assert got[("RZ", dt.date(2001, 7, 3))] == 0       # one day before it does not


def test_flag_and_anti(spark):
    pays = spark.createDataFrame(
        [("A", dt.date(2001, 7, 2)), ("A", dt.date(2001, 7, 3)), ("B", dt.date(2001, 6, 30)),
         (None, dt.date(2001, 7, 5))], "ref_number string, payment_date date")
    base = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "ref_number string")
    k = keys_with_rows(pays, "ref_number", "payment_date", dt.date(2001, 7, 1), dt.date(2001, 8, 1))
    flagged = {r.ref_number: r.f for r in flag_if_exists(base, k, "ref_number", "f").collect()}
    assert flagged == {"A": 1, "B": 0, "C": 0, None: 0}
    anti = sorted((r.ref_number or "") for r in without_match(base, k, "ref_number").collect())
    assert anti == ["", "B", "C"]       # NOT EXISTS keeps the null key row
