"""Streaming forms against their batch results."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from arrears.sources.driver_dates import events_params
from arrears.plans import facts
from arrears.sources.catalog import DriverSources
from arrears.sources.schemas import struct
from arrears.streaming.activity import daily_activity
from arrears.streaming.ingest import land_stream
from conftest import SF_SMALL


def _scratch(spark):
    return tempfile.mkdtemp(prefix="run-", dir=spark.conf.get("spark.checkpoint.dir"))


def test_landing_stream(spark):
    src = DriverSources(spark, SF_SMALL)
    base = _scratch(spark)
    inp, out = os.path.join(base, "in"), os.path.join(base, "out")
    ce = src.contact_events
    ce.where(F.col("contact_date") < "2024-01-15").write.parquet(inp, mode="append")
    q = land_stream(spark, "contact_events", inp, out, checkpoint=os.path.join(base, "ck"))
    q.awaitTermination()
    ce.where(F.col("contact_date") >= "2024-01-15").write.parquet(inp, mode="append")
    q = land_stream(spark, "contact_events", inp, out, checkpoint=os.path.join(base, "ck"))
    q.awaitTermination()
    landed = spark.read.parquet(out)
    assert landed.count() == ce.count()              # each file exactly once
    assert landed.where(F.col("_source") != "operational.contact_events").count() == 0


def test_daily_activity_stream_matches_batch(spark):
    src = DriverSources(spark, SF_SMALL)
    p = events_params()
    base = _scratch(spark)
    inp = os.path.join(base, "in")
    # files arrive in time order (one per week), as a landing would produce
    ce = src.contact_events
    for lo, hi in [("2023-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"),
                   ("2024-01-15", "2024-01-22"), ("2024-01-22", "2025-01-01")]:
        ce.where((F.col("contact_date") >= lo) & (F.col("contact_date") < hi)).coalesce(1) \
          .write.parquet(inp, mode="append")
    stream = spark.readStream.schema(struct("contact_events")).option("maxFilesPerTrigger", 1).parquet(inp)
    q = (daily_activity(stream, src.users, p.calendar_start, lateness="0 seconds")
         .writeStream.format("memory").queryName("act").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.user_name, r.contact_date): (r.user_id, r.contact_count)
           for r in spark.sql("select * from act").collect()}
    batch = {(r.user_name, r.contact_date): (r.user_id, r.contact_count)
             for r in facts.cc_operator_activity(src, p).collect()}
    assert got, "no finished day was emitted"
    # every emitted day is final and equal to the batch count
    for k, v in got.items():
        assert batch[k] == v
    # all days before the last event day were finished
    last = max(d for _, d in batch)
    assert {k for k in batch if k[1] < last - dt.timedelta(days=1)} <= set(got)
