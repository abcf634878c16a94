"""Landing by day, safe overwrites, upkeep by changes, typed loads with rejects, profiles."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arrears.plans import facts, upkeep
from arrears.plans.views import USERS_FILE
from arrears.session import shared_path
from arrears.sources import profile, typed
from arrears.sources.catalog import DriverSources, Sources
from arrears.sources.driver_dates import orders_params
from arrears.sources.sink import land_bronze, land_days, replace_days, restore_table, write_table
from conftest import SF_SMALL


def local(path):
    return path.removeprefix("file://")


def days_of(path):
    return sorted(x[5:] for x in os.listdir(local(path)) if x.startswith("_day="))


def files(path):
    return {os.path.join(a, f): os.path.getmtime(os.path.join(a, f)) for a, _, fs in os.walk(local(path)) for f in fs
            if f.endswith(".parquet")}


class Given(Sources):
    def __init__(self, spark, **rels):
        super().__init__(spark)
        self._memo.update(rels)


def contacts(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, d, 10), v) for i, d, v in rows],
                                 "contact_id long, contact_date timestamp_ntz, contact_text string")


def test_a_day_is_replaced_and_others_stay(spark):
    base = shared_path(spark, "test-landing")
    path = f"{base}/contact_events"
    land_bronze(Given(spark, contact_events=contacts(spark, [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")])), base,
                relations=["contact_events"])
    before = files(path)
    src = Given(spark, contact_events=contacts(spark, [(1, 1, "A"), (2, 2, "B"), (4, 2, "new"), (3, 3, "C")]))
    for _ in range(2):  # a repeat changes nothing
        land_days(src, base, "contact_events", [dt.date(2024, 1, 2)])
        got = {(r["contact_id"], r["contact_text"]) for r in spark.read.parquet(path).collect()}
        assert got == {(1, "a"), (2, "B"), (4, "new"), (3, "c")}
    after = files(path)
    for day in ("2024-01-01", "2024-01-03"):
        assert {f for f in before.items() if day in f[0]} == {f for f in after.items() if day in f[0]}


def test_a_day_without_rows_goes(spark):
    base = shared_path(spark, "test-landing")
    land_bronze(Given(spark, contact_events=contacts(spark, [(1, 1, "a"), (2, 2, "b")])), base, relations=["contact_events"])
    land_days(Given(spark, contact_events=contacts(spark, [(1, 1, "a")])), base, "contact_events",
              [dt.date(2024, 1, 2), dt.date(2024, 1, 9)])
    assert days_of(f"{base}/contact_events") == ["2024-01-01"]
    land_days(Given(spark, contact_events=contacts(spark, [])), base, "contact_events", [])
    assert days_of(f"{base}/contact_events") == ["2024-01-01"]


def test_a_failed_overwrite_keeps_the_table(spark):
    path = shared_path(spark, "test-table")
    write_table(spark.range(5), path)
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        write_table(broken, path)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    assert not [x for x in os.listdir(os.path.dirname(local(path))) if x.startswith(f"{os.path.basename(path)}.old-")]


def test_a_replacement_cut_short_is_put_back(spark):
    path = shared_path(spark, "test-table")
    write_table(spark.range(5), path)
    os.rename(local(path), f"{local(path)}.old-x")
    assert restore_table(spark, path) and spark.read.parquet(path).count() == 5
    assert not restore_table(spark, path)


def test_days_are_replaced_without_a_shuffle_of_others(spark):
    path = shared_path(spark, "test-days")
    rows = spark.range(100).select("id", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 10).cast("int")).alias("_day"))
    replace_days(rows, path, files_per_day=2)
    replace_days(rows.where("id % 10 = 3").withColumn("id", -F.col("id")), path)
    got = spark.read.parquet(path)
    assert got.count() == 100 and got.where("id < 0").count() == 10


# ---- upkeep
def test_upkeep_equals_a_rebuild(spark):
    """Random inserts, changes and deletes, several rounds."""
    rng, p = random.Random(5), orders_params()
    src = DriverSources(spark, SF_SMALL)
    everything = src.ptp_overview.orderBy("ptp_id").limit(400).cache()
    ids = [r[0] for r in everything.select("ptp_id").collect()]
    path = shared_path(spark, "test-upkeep")
    state = {i: 0 for i in rng.sample(ids, 250)}

    def source():
        amounts = spark.createDataFrame(list(state.items()), "ptp_id long, extra int")
        rows = everything.join(F.broadcast(amounts), "ptp_id").withColumn("promise_capital", F.col("promise_capital") + F.col("extra"))
        return upkeep.With(src, ptp_overview=rows.select(*everything.columns))

    upkeep.store_fact_ptp(source(), p, path, files_per_day=1)
    for _ in range(2):
        touched = set()
        for i in rng.sample(ids, 30):
            touched.add(i)
            if i not in state:
                state[i] = 0
            elif rng.random() < 0.5:
                del state[i]
            else:
                state[i] += 7
        changed = upkeep.pairs_of(everything.where(F.col("ptp_id").isin(list(touched))))
        for _ in range(2):  # a repeat changes nothing
            upkeep.refresh_fact_ptp(source(), p, path, changed, files_per_day=1)
        want = facts.fact_ptp(source(), p)
        got = upkeep.read_fact_ptp(src, path)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))
    before = files(path)
    upkeep.refresh_fact_ptp(source(), p, path, changed.limit(1), files_per_day=1)
    day = changed.limit(1).collect()[0]["day"].isoformat()
    assert all(f in files(path) for f in before if f"contact_date={day}" not in f)


# ---- typed loads
def test_typed_cells(spark):
    path = shared_path(spark, "test-text")
    lines = ["1,ann,ann a,1,200,2024-01-01,2024-01-02", "2,bob,b,1,n/a,2024-01-01,", "3,c,c,x,199.5,2024-13-01,",
             "4,d,d,1,,2024-01-01,2024-01-01", "5,e,e", "6,f,f,1,1,2024-01-01,2024-01-01,more", ",,,,,,"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    parsed = typed.typed(typed.read_lines(spark, path), USERS_FILE).cache()
    ok = {r["user_id"]: r for r in typed.accepted(parsed).collect()}
    assert set(ok) == {1, 4, None} and ok[4]["sip_account"] is None and ok[1]["insert_date"] == dt.date(2024, 1, 1)
    bad = {(r["line"].split(",")[0], r["column_name"], r["value"], r["reason"]) for r in typed.rejects(parsed).collect()}
    assert bad == {("2", "sip_account", "n/a", "no int"), ("3", "user_status", "x", "no int"),
                   ("3", "sip_account", "199.5", "no int"), ("3", "insert_date", "2024-13-01", "no date"),
                   ("5", "", lines[4], "not the declared fields"), ("6", "", lines[5], "not the declared fields")}
    report = {(r["outcome"], r["column_name"]): r["n"] for r in typed.load_report(parsed).collect()}
    assert report["read", ""] == len(lines) == report["accepted", ""] + report["rejected", ""]


# ---- profiles
def test_united_days_keep_the_stated_errors(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("d"), (F.col("id") % 9000).alias("k"), F.pow(F.col("id") / 1000, F.lit(2)).alias("x"))
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("d").cast("int"))
    days = profile.profile_days(rows, day, ["k"], ["x"])
    path = shared_path(spark, "test-profile")
    days.write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 7
    for part, n in ((stored, 60_000), (stored.where("day < '2024-01-04'"), None)):
        one = profile.unite(part, ["k"], ["x"]).first()
        exact = rows.where("d < 3") if n is None else rows
        assert one["rows"] == exact.count()
        assert abs(one["distinct_k"] - exact.select("k").distinct().count()) <= 0.05 * 9000
        for f, q in zip((0.1, 0.5, 0.9), one["quantiles_x"]):
            assert abs(exact.where(F.col("x") <= q).count() / one["rows"] - f) <= profile.RANK_ERROR
    whole = profile.unite(profile.profile_days(rows, F.lit(dt.date(2024, 1, 1)), ["k"], ["x"]), ["k"], ["x"]).first()
    assert abs(whole["distinct_k"] - profile.unite(stored, ["k"], ["x"]).first()["distinct_k"]) <= 0.05 * 9000
