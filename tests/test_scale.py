"""Work and memory that grow no faster than the rows: landing passes, stream feeds, the star join's plan."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from arrears.plans import views
from arrears.plans.model import Model
from arrears.session import shared_path
from arrears.sources.catalog import DriverSources, Sources
from arrears.sources.driver_dates import events_params, orders_params
from arrears.sources.schemas import SCHEMAS, struct
from arrears.streaming import match
from conftest import SF_SMALL


def test_landing_reads_a_relation_once_per_step(spark):
    """Counting its days, landing it and landing its first day twice are four passes over a relation."""
    class Given(Sources):
        def _load(self, name):
            return spark.createDataFrame([tuple(None for _ in struct(name))], struct(name))

    seen, n = spark.sparkContext.accumulator(0), 90

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    src, schema = Given(spark), struct("contact_events")
    rows = [(i, 1, 1, dt.datetime(2024, 1, 1 + i % 2, 10), "d", 1, 1, "t", "u") for i in range(n)]
    src._memo["contact_events"] = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(counted, schema)
    got = {r["relation"]: r for r in views.bronze_landing(src).collect()}
    assert seen.value == 4 * n
    assert got["contact_events"].asDict() == {"relation": "contact_events", "row_count": n, "column_count": 11,
                                              "sourced_rows": n, "stamped_rows": n, "days": 2}
    assert set(got) == set(SCHEMAS) and all(got[name]["row_count"] == 1 for name in SCHEMAS if name != "contact_events")


def test_payments_move_once_to_their_joins(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set(key, "-1")
        plan = DriverSources(spark, SF_SMALL).payments._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan)
    assert joins == ["l_orderkey", "o_custkey"]


def test_star_join_adds_up_after_the_dimensions(spark):
    model = Model(DriverSources(spark, SF_SMALL), events_params(), orders_params())
    plan = views.star_join(model)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert not [k for k in keys if re.match(r"_groupingexpression#\d+L, _groupingexpression#\d+L", k)]  # client, case


def test_a_large_step_has_several_files_and_stays_one_trigger(spark):
    t = F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id") % 40_000).cast("timestamp_ntz")
    df = spark.range(0, 60_000, numPartitions=3).select(F.col("id").alias("uniqueid"), t.alias("call_date"))
    df = df.unionByName(df.where("uniqueid % 3 = 0").withColumn("call_date", F.col("call_date") + F.expr("interval 1 minute")))
    cut = dt.datetime.fromtimestamp(1_704_120_000, dt.timezone.utc).replace(tzinfo=None)
    path = shared_path(spark, "test-steps")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in small}
    held = []

    def counted(step):
        step()
        held.append(len([f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".parquet")]))

    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out, q = match.run_by_steps(lambda: match.calls_once(match.read_feed(spark, df.schema, path, None)), "test-steps-out",
                                    spark, [lambda step=step: counted(step) for step in match.feed_steps(df, "call_date", [cut], path)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held[0] > 1 and held[1] > held[0] + 1
    assert out.count() == 60_000 == out.select("uniqueid").distinct().count()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 6_000  # what came in the last lateness
