"""Contacts and calls as streams: the interval join with two watermarks, and calls without repeats.

Both keep bounded state. A call or contact leaves the state when the watermark has passed its
tolerance, so a key holds what came in the last ``tolerance + lateness`` minutes and no more.
Rows that come later than ``lateness`` are dropped, as the watermark promises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arrears import config as C
from arrears.config import Params
from arrears.plans import facts
from arrears.session import shared_path
from arrears.sources.catalog import Sources

col = F.col


def _timed(df: DataFrame, c: str, lateness: str, name: str) -> DataFrame:
    # Watermarks need a zoned timestamp; both sides are cast alike.
    return df.withColumn(name, col(c).cast("timestamp")).withWatermark(name, lateness)


def interval_matches(contacts: DataFrame, calls: DataFrame, tolerance_minutes: int = C.MATCH_TOLERANCE_MINUTES,
                     lateness: str = "10 minutes") -> DataFrame:
    """Every contact with every call of its telecom and case within the tolerance, both ends
    included; a contact without one comes once, with nulls, when no call can follow any more."""
    k = _timed(contacts, "contact_date", lateness, "_contact_time").select(
        "contact_id", col("telecom_id").alias("_kt"), col("case_id").alias("_kc"), "_contact_time")
    d = _timed(calls, "call_date", lateness, "_call_time").select(
        "uniqueid", col("telecom_id").alias("_dt"), col("case_id").alias("_dc"), "campaign_id", "campaign_name", "_call_time")
    reach = F.expr(f"interval {int(tolerance_minutes)} minutes")
    near = (col("_call_time") >= col("_contact_time") - reach) & (col("_call_time") <= col("_contact_time") + reach)
    return k.join(d, (col("_kt") == col("_dt")) & (col("_kc") == col("_dc")) & near, "leftOuter").select(
        "contact_id", "uniqueid", "campaign_id", "campaign_name", col("_call_time").cast("timestamp_ntz").alias("call_date"))


def calls_once(calls: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Calls without repeats of an id that come within the lateness of one another."""
    return _timed(calls, "call_date", lateness, "_call_time").dropDuplicatesWithinWatermark(["uniqueid"]).drop("_call_time")


# ---- files in order of time, read as a stream
def feed_steps(df: DataFrame, c: str, cuts: list, path: str) -> list[Callable[[], None]]:
    """Writers of steps that follow one another in time: the rows before the first cut, those up to
    the next, and so on. Every task writes a bounded part of a step, so a large step has several files."""
    bounds, steps = [None, *cuts, None], []
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(col(c) >= F.lit(lo))
        if hi is not None:
            part = part.where(col(c) < F.lit(hi))
        steps.append(lambda part=part: part.hint("rebalance").write.mode("append").parquet(path))
    return steps


def feed(df: DataFrame, c: str, cuts: list, path: str) -> None:
    """All steps, one after another; files of later steps are newer."""
    for step in feed_steps(df, c, cuts, path):
        step()


def read_feed(spark: SparkSession, schema, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The files as a stream; None: each trigger takes all files there are."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def _run(df: DataFrame, out: str) -> StreamingQuery:
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_to_end(df: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over all files there are, in as many triggers as they need, into a table."""
    spark, out = df.sparkSession, shared_path(df.sparkSession, name)
    q = _run(df, out)
    return spark.read.schema(df.schema).parquet(out), q


def run_by_steps(stream: Callable[[], DataFrame], name: str, spark: SparkSession,
                 *feeds: list[Callable[[], None]]) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream of whole-feed triggers into a table, from one checkpoint: each step of the feeds
    is one trigger, however many files it has. The empty trigger that moves the watermark on comes
    once, after the last step, as in one run over all files."""
    out, idle, df = shared_path(spark, name), "spark.sql.streaming.noDataMicroBatches.enabled", None
    before, left = spark.conf.get(idle), len(feeds[0])
    try:
        spark.conf.set(idle, "false")
        for steps in zip(*feeds, strict=True):
            for step in steps:
                step()
            left -= 1
            if not left:
                spark.conf.set(idle, before)
            df = df or stream()  # a stream needs its folder
            q = _run(df, out)
    finally:
        spark.conf.set(idle, before)
    return spark.read.schema(df.schema).parquet(out), q


def interval_latest_stream(src: Sources, p: Params) -> DataFrame:
    """The latest call of each contact (JO1, JO2) from the stream of matches."""
    spark = src.spark
    cb = facts.contact_base(src, p).select("contact_id", "telecom_id", "case_id", "contact_date")
    calls = src.dialer_calls.select("uniqueid", "telecom_id", "case_id", "campaign_id", "campaign_name", "call_date")
    cuts = _cuts(p)
    paths = shared_path(spark, "stream-contacts"), shared_path(spark, "stream-calls")

    def matches() -> DataFrame:
        return interval_matches(read_feed(spark, cb.schema, paths[0], None), read_feed(spark, calls.schema, paths[1], None),
                                p.tolerance_minutes)

    found, _ = run_by_steps(matches, "stream-matches", spark, feed_steps(cb, "contact_date", cuts, paths[0]),
                            feed_steps(calls, "call_date", cuts, paths[1]))
    found = found.where(col("uniqueid").isNotNull())
    bridge = facts.dialer_contact_dedup(src).select(col("unique_id").alias("_uid"), col("contact_id").alias("dialer_contact_id"))
    match = F.struct("call_date", "uniqueid", "campaign_id", "campaign_name", "dialer_contact_id").alias("match")
    best = found.join(bridge, found["uniqueid"] == bridge["_uid"], "left").select("contact_id", match)
    best = best.groupBy("contact_id").agg(F.max_by("match", F.struct("match.call_date", "match.uniqueid")).alias("match"))
    return best.select("contact_id", "match.dialer_contact_id", "match.campaign_id", "match.campaign_name",
                       col("match.uniqueid").alias("dialer_call_id"))


def calls_once_stream(src: Sources, p: Params) -> DataFrame:
    """Calls by id and how often each came through, from a feed that repeats every fifth call a
    minute later."""
    spark, path = src.spark, shared_path(src.spark, "stream-repeats")
    calls = src.dialer_calls.select("uniqueid", "call_date")
    again = calls.where(F.abs("uniqueid") % 5 == 0).withColumn("call_date", col("call_date") + F.expr("interval 1 minute"))
    found, _ = run_by_steps(lambda: calls_once(read_feed(spark, calls.schema, path, None)), "stream-once", spark,
                            feed_steps(calls.unionByName(again), "call_date", _cuts(p), path))
    return found.groupBy("uniqueid").agg(F.count(F.lit(1)).alias("copies"))


def _cuts(p: Params) -> list:
    import datetime as dt

    days = (p.as_of - p.calendar_start).days
    return [p.calendar_start + dt.timedelta(days=days * k // 4) for k in (1, 2, 3)]
