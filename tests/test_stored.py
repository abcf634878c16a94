"""KPI cube, day pruning, buckets, fan-out by degrees: results and plans."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arrears.plans import cube, kpi, quality, stored
from arrears.plans.model import Model
from arrears.session import shared_path
from arrears.sources.catalog import DriverSources
from arrears.sources.driver_dates import events_params, orders_params
from arrears.streaming import match
from conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return Model(DriverSources(spark, SF_SMALL), events_params(), orders_params())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


# ---- cube
@pytest.fixture(scope="module")
def cells(model):
    return cube.kpi_cube(model).collect()


def test_cube_agrees_with_the_kpis_at_their_grain(model, cells):
    by_seat = {r["operator_id"]: r for r in cells if r["level"] == 5}
    for r in kpi.dialer_score(model).collect():
        assert by_seat[r["operator_id"]]["dialer_score"] == r["dialer_score"]
    for r in kpi.absence(model).collect():
        assert by_seat[r["users_id"]]["absence_pct"] == r["absence_pct"]
    by_client = {r["client_id"]: r for r in cells if r["level"] == 3}
    for r in kpi.recovery(model).collect():
        assert by_client[r["client_id"]]["recovery_pct"] == r["recovery_pct"]
    for r in kpi.commission(model).collect():
        assert by_client[r["client_id"]]["commission"] == pytest.approx(r["commission_value"] or 0.0)


def test_every_total_is_the_sum_of_its_parts(cells):
    """Each level against a plain sum over the finest one."""
    fine = [r for r in cells if r["level"] == 0]
    assert sorted({r["level"] for r in cells}) == list(range(8))
    for level in range(1, 8):
        kept = [d for k, d in enumerate(cube.DIMS) if not level >> (2 - k) & 1]
        want = defaultdict(lambda: defaultdict(int))
        for r in fine:
            for s in cube.COUNTS:
                want[tuple(r[d] for d in kept)][s] += r[s] or 0
        got = {tuple(r[d] for d in kept): {s: r[s] or 0 for s in cube.COUNTS} for r in cells if r["level"] == level}
        assert got == want
        assert all(r[d] is None for r in cells if r["level"] == level for d in set(cube.DIMS) - set(kept))


def test_cube_reads_each_fact_once(model):
    plan = cube.kpi_cube(model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "grouping_id" in plan.lower()


# ---- day pruning
def test_the_calendar_filter_prunes_day_folders(spark, model):
    df = stored.calls_of_week(model)
    assert "dynamicpruning" in plan_of(df)
    got = {r["call_date"] for r in df.collect()}
    assert got and all(8 <= d.day <= 14 for d in got)


# ---- buckets
def test_bucketed_joins_move_no_fact(spark, no_broadcast):
    src, p = DriverSources(spark, SF_SMALL), orders_params()
    for df in (stored.fact_payments_bucketed(src, p), stored.dim_cases_bucketed(src, p)):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    plain = plan_of(__import__("arrears.plans.facts", fromlist=["x"]).fact_payments(src, p))
    assert "Exchange" in plain


def test_a_hot_bucket_stays_a_plain_table(spark, no_broadcast):
    even = spark.range(2000).withColumnRenamed("id", "case_id")
    hot = even.withColumn("case_id", F.when(F.col("case_id") % 3 == 0, 7).otherwise(F.col("case_id")))
    assert stored.hottest_bucket(even, "case_id", 32) < 2 < 8 < stored.hottest_bucket(hot, "case_id", 32)
    for df, bucketed in ((even, True), (hot, False)):
        out = stored.write_bucketed(df, "case_id", 32, shared_path(spark, "test-buckets"))
        assert out.count() == 2000
        assert ("Exchange" not in plan_of(out.groupBy("case_id").count())) == bucketed
    assert stored.hottest_bucket(even.where("false"), "case_id", 4) == 0.0


# ---- fan-out
def test_debtor_fanout_is_the_join_size(spark):
    model = Model(DriverSources(spark, SF_CHECK), events_params(), orders_params())  # debtors with several cases
    got = {r["fact"]: r for r in quality.debtor_fanout(model).collect()}
    cases = model.src.cases
    for name in ("fact_dialer", "fact_payments"):
        f = getattr(model, name).select("case_id")
        owned = f.join(cases.select("case_id", "debtor_id"), "case_id")
        brute = owned.join(cases.select("debtor_id", F.col("case_id").alias("other")), "debtor_id")
        assert got[name]["joined_rows"] == brute.count() and got[name]["fact_rows"] == owned.count()
    assert got["fact_payments"]["joined_rows"] > got["fact_payments"]["fact_rows"]


def test_checks_can_fail(spark, model):
    assert all(r["extra_rows"] > 0 for r in quality.fanout_plain(model).collect())
    assert any(r["duplicate_keys"] > 0 for r in quality.documented_keys(model).collect())
    found = {r["column_name"]: r for r in quality.source_domains(model).collect()}
    assert found["dialer_calls.disposition"]["unknown_rows"] > 0 and found["ptp_overview.state"]["null_rows"] > 0
    assert any(r["broken_rows"] > 0 for r in quality.cross_implications(model).collect())
    assert quality.presence_gaps_planted(model).count() > 0 and quality.presence_gaps(model).count() == 0


# ---- streams
def stream_rows(spark, rows, schema, c, cuts, name):
    path = shared_path(spark, name)
    df = spark.createDataFrame(rows, schema)
    match.feed(df, c, cuts, path)
    return match.read_feed(spark, df.schema, path)


def test_interval_stream_edges_and_late_rows(spark):
    import datetime as dt

    t = lambda m, s=0: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m, seconds=s)
    contacts = [(1, 5, 5, t(0)), (2, 5, 5, t(60)), (3, 6, 6, t(0)), (4, 5, 5, t(60)), (9, 0, 0, t(600))]
    calls = [(10, 5, 5, 1, "a", t(15)), (11, 5, 5, 1, "a", t(15, 1)), (12, 5, 5, 1, "a", t(-15)), (13, 5, 6, 1, "a", t(0)),
             (14, 5, 5, 2, "b", t(45)), (15, 5, 5, 2, "b", t(75)), (19, 0, 0, 1, "z", t(1000))]
    k = stream_rows(spark, contacts, "contact_id long, telecom_id long, case_id long, contact_date timestamp_ntz",
                    "contact_date", [t(30), t(300)], "test-contacts")
    d = stream_rows(spark, calls, "uniqueid long, telecom_id long, case_id long, campaign_id int, campaign_name string, "
                    "call_date timestamp_ntz", "call_date", [t(30), t(300)], "test-calls")
    out, q = match.run_to_end(match.interval_matches(k, d), "test-matches")
    got = {(r["contact_id"], r["uniqueid"]) for r in out.collect()}
    # Contact 9 is newer than the watermark: nothing is said about it yet.
    assert got == {(1, 10), (1, 12), (2, 14), (2, 15), (4, 14), (4, 15), (3, None)}
    state = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    assert max(state) <= 2  # what the last quarter of an hour may still meet


def test_repeats_go_and_the_state_empties(spark):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    rows = [(k, t(k % 50)) for k in range(200)] + [(k, t(k % 50 + 1)) for k in range(0, 200, 2)] + [(999, t(600)), (1000, t(1200))]
    calls = stream_rows(spark, rows, "uniqueid long, call_date timestamp_ntz", "call_date", [t(20), t(300), t(1000)], "test-repeats")
    out, q = match.run_to_end(match.calls_once(calls), "test-once")
    ids = [r["uniqueid"] for r in out.collect()]
    assert sorted(ids) == [*range(200), 999, 1000]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
