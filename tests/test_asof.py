"""As-of match and interval count against brute force, including exact
window edges, equal timestamps, a hot key and duplicate left ids."""

import datetime as dt
import random

import pytest

from arrears.operators.asof import count_within, nearest_within

L_SCHEMA = "contact_id bigint, telecom_id bigint, case_id bigint, contact_date timestamp_ntz"
R_SCHEMA = ("uniqueid bigint, telecom_id bigint, case_id bigint, call_date timestamp_ntz, "
            "campaign_id bigint")
T0 = dt.datetime(2024, 1, 10, 10, 0, 0)


def brute(left, right, tol_min):
    tol = dt.timedelta(minutes=tol_min)
    best, counts = {}, {}
    for cid, tel, case, ts in left:
        if None in (tel, case, ts):
            continue
        for uid, rtel, rcase, rts, camp in right:
            if rtel == tel and rcase == case and rts is not None and ts - tol <= rts <= ts + tol:
                counts[cid] = counts.get(cid, 0) + 1
                if cid not in best or (rts, uid) > best[cid][:2]:
                    best[cid] = (rts, uid, camp)
    return {k: (v[1], v[2]) for k, v in best.items()}, counts


def run(spark, left, right, tol, minutes):
    l = spark.createDataFrame(left, L_SCHEMA)
    r = spark.createDataFrame(right, R_SCHEMA)
    m = nearest_within(l, r, ["telecom_id", "case_id"], "contact_id", "contact_date", "call_date",
                       "uniqueid", ["uniqueid", "campaign_id"], tol, minutes)
    c = count_within(l, r, ["telecom_id", "case_id"], "contact_id", "contact_date", "call_date",
                     tol, minutes)
    got = {row.contact_id: (row.uniqueid, row.campaign_id) for row in m.collect()}
    cnt = {row.contact_id: row.matches for row in c.collect()}
    return got, cnt


def test_window_edges_and_ties(spark):
    s = dt.timedelta(seconds=1)
    m15 = dt.timedelta(minutes=15)
    left = [(1, 7, 7, T0), (2, 7, 7, T0 + dt.timedelta(hours=5)), (3, None, 7, T0)]
    right = [
        (10, 7, 7, T0 - m15, 100),          # -15:00 included
        (11, 7, 7, T0 + m15, 101),          # +15:00 included (latest)
        (12, 7, 7, T0 - m15 - s, 102),      # -15:01 excluded
        (13, 7, 7, T0 + m15 + s, 103),      # +15:01 excluded
        (14, 7, 7, T0 + dt.timedelta(minutes=5), 104),
        (15, 7, 8, T0, 105),                # same telecom, other case
        # contact 2: two calls with the same timestamp -> larger id wins
        (20, 7, 7, T0 + dt.timedelta(hours=5, minutes=1), 200),
        (21, 7, 7, T0 + dt.timedelta(hours=5, minutes=1), 201),
    ]
    got, cnt = run(spark, left, right, 15, 60)
    assert got == {1: (11, 101), 2: (21, 201)}
    assert cnt == {1: 3, 2: 2}


@pytest.mark.parametrize("seed,minutes", [(1, 60), (2, 7), (3, 1), (4, 300), (5, 30)])
def test_random_with_hot_key(spark, seed, minutes):
    rnd = random.Random(seed)

    def ts():
        # minute resolution over 3 days: many exact-edge and equal timestamps
        return T0 + dt.timedelta(minutes=rnd.randrange(0, 3 * 24 * 60, 3))

    def key():
        t = 1 if rnd.random() < 0.4 else rnd.randrange(2, 9)   # telecom 1 is hot
        return t, t if rnd.random() < 0.8 else t + 100

    left = []
    for i in range(300):
        t, c = key()
        left.append((i % 280, t, c, ts()))   # some duplicate contact ids
    right = []
    for i in range(900):
        t, c = key()
        right.append((1000 + i, t, c, ts(), rnd.randrange(5)))
    want_best, want_cnt = brute(left, right, 15)
    got, cnt = run(spark, left, right, 15, minutes)
    assert got == want_best
    assert cnt == want_cnt


def test_wide_tolerance_widens_buckets(spark):
    left = [(1, 1, 1, T0)]
    right = [(5, 1, 1, T0 - dt.timedelta(minutes=170), 1), (6, 1, 1, T0 - dt.timedelta(minutes=190), 2)]
    got, cnt = run(spark, left, right, 180, 60)
    assert got == {1: (5, 1)} and cnt == {1: 1}


def test_rows_bunched_at_one_instant(spark):
    """A third of all rows on one key and one instant: the window sees one row
    per distinct time, and every row still gets its answer."""
    hot = [(k, 7, 7, T0) for k in range(2000)]
    left = hot + [(10_000 + k, k, k, T0 + dt.timedelta(minutes=k % 40)) for k in range(200)]
    right = [(k, 7, 7, T0, k % 3) for k in range(2000)] + [
        (20_000 + k, k, k, T0 + dt.timedelta(minutes=20), k) for k in range(200)]
    got, cnt = run(spark, left, right, 15, 60)
    best, counts = brute(left[1990:], right, 15)
    assert {k: got[k] for k in best} == best and {k: cnt[k] for k in counts} == counts
    assert all(got[k] == (1999, 1) and cnt[k] == 2000 for k in range(2000))
    l, r = spark.createDataFrame(left, L_SCHEMA), spark.createDataFrame(right, R_SCHEMA)
    for df in (nearest_within(l, r, ["telecom_id", "case_id"], "contact_id", "contact_date", "call_date",
                              "uniqueid", ["campaign_id"], 15),
               count_within(l, r, ["telecom_id", "case_id"], "contact_id", "contact_date", "call_date", 15)):
        plan = df._jdf.queryExecution().optimizedPlan()
        window = next(n for n in _nodes(plan) if n.nodeName() == "Window")
        groups = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
            spark._jsparkSession, window.child())
        assert groups.filter("telecom_id = 7 and case_id = 7").count() <= 12     # times, copies and ends


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))
