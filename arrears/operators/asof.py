"""Nearest-earlier match within a tolerance (an as-of join).

Semantics: for every left row, among the right rows with equal keys and
``left_ts - tol <= right_ts <= left_ts + tol`` (both ends included), take
the one with the greatest ``(right_ts, tie)``. This is "interval join,
then latest match" without ever materialising the candidate pairs.

Plan: the latest right row at or before ``left_ts + tol`` is found with a
running max over one sorted stream of both sides; it is a match when it is
not older than ``left_ts - tol``. Streams are split by key *and* a time
bucket of ``bucket_minutes``; a left row goes to the bucket of its window
end and each right row at ``t`` is copied into the buckets of
``t .. t + 2 * tol`` (the window ends it can serve), so every bucket holds
all right rows any of its windows can see. A key holding a third of all rows is spread over as
many tasks as it has busy buckets; a narrower bucket splits it further
(more copies of the right side, smaller groups). Exact for any width.

Rows of one key bunched at one instant never reach the stream: the right
side enters as one row per (keys, time) by partial aggregation, the left
side as distinct (keys, time), so a group holds at most its distinct
times. The answer per (keys, time) then joins back to the left rows, a
plain join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts: Column, minutes: int) -> Column:
    # Minutes since 1970-01-01 from calendar fields: independent of time zone.
    m = F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.floor(m / F.lit(minutes)).cast("bigint")


def _copies(ts: Column, tolerance_minutes: int, minutes: int) -> Column:
    """Buckets a right row at ``ts`` must be visible in: those holding the
    window ends it can serve, i.e. ``bucket(ts) .. bucket(ts + 2 * tol)``
    (1 + 2 * tol / width copies on average)."""
    reach = ts + F.expr(f"INTERVAL {2 * int(tolerance_minutes)} MINUTES")
    return F.explode(F.sequence(_bucket(ts, minutes), _bucket(reach, minutes)))


def match_rows(left: DataFrame, right: DataFrame, keys: Sequence[str],
               left_id: str, left_ts: str, right_ts: str, tie: str,
               payload: Sequence[str], tolerance_minutes: int,
               bucket_minutes: int = 60) -> DataFrame:
    """(``left_id``, ``match``) for every left row with a match, where
    ``match`` is struct(ts, tie, *payload) of the latest right row within
    the tolerance."""
    bucket_minutes = max(1, int(bucket_minutes))
    tol = F.expr(f"INTERVAL {int(tolerance_minutes)} MINUTES")
    rows = _timed(left, keys, left_ts).select(*keys, F.col(left_ts).alias("__lts"), F.col(left_id).alias("__lid"))
    l = (rows.select(*keys, "__lts").distinct()
             .withColumn("__t", F.col("__lts") + tol)
             .withColumn("__b", _bucket(F.col("__t"), bucket_minutes)))
    rec = F.struct(F.col(right_ts).alias("ts"), F.col(tie).alias("tie"),
                   *[F.col(c).alias(c) for c in payload])
    r = (_timed(right, keys, right_ts).groupBy(*keys, F.col(right_ts).alias("__t")).agg(F.max(rec).alias("__rec"))
              .select(*keys, "__t", "__rec",
                      _copies(F.col("__t"), tolerance_minutes, bucket_minutes).alias("__b")))

    stream = (r.select(*keys, "__b", "__t", F.lit(0).alias("__kind"), "__rec",
                       F.lit(None).cast("timestamp_ntz").alias("__lts"))
              .unionByName(l.select(*keys, "__b", "__t", F.lit(1).alias("__kind"),
                                    F.lit(None).cast(r.schema["__rec"].dataType).alias("__rec"), "__lts")))
    w = (Window.partitionBy(*keys, "__b").orderBy("__t", "__kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = (stream.withColumn("match", F.max("__rec").over(w))
                  .where((F.col("__kind") == 1) & F.col("match").isNotNull())
                  .where(F.col("match.ts") >= F.col("__lts") - tol)
                  .select(*keys, "__lts", "match"))
    # One row per left row that has a match. A left id may occur on several
    # rows: ``latest_per_id`` keeps its overall latest match.
    return rows.join(best, [*keys, "__lts"]).select(F.col("__lid").alias(left_id), "match")


def latest_per_id(matches: DataFrame, left_id: str, payload: Sequence[str]) -> DataFrame:
    """Reduce ``match_rows`` output to one row per left id (the latest match)
    and flatten the payload. Extra fields added to ``match`` ride along."""
    per_id = matches.groupBy(left_id).agg(F.max("match").alias("match"))
    return per_id.select(left_id, *[F.col(f"match.{c}").alias(c) for c in payload])


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   left_id: str, left_ts: str, right_ts: str, tie: str,
                   payload: Sequence[str], tolerance_minutes: int,
                   bucket_minutes: int = 60) -> DataFrame:
    """Return ``left_id`` + ``payload`` columns of the matched right row
    (only left rows that have a match; join back with a left join)."""
    rows = match_rows(left, right, keys, left_id, left_ts, right_ts, tie, payload,
                      tolerance_minutes, bucket_minutes)
    return latest_per_id(rows, left_id, payload)


def _timed(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows that can match: no key and no time is null."""
    for c in [*keys, ts]:
        df = df.where(F.col(c).isNotNull())
    return df


def count_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str,
                 left_ts: str, right_ts: str, tolerance_minutes: int,
                 bucket_minutes: int = 60, out: str = "matches") -> DataFrame:
    """Number of right rows with equal keys inside each left row's
    ``[ts - tol, ts + tol]`` window (left ids with at least one), i.e. the
    cardinality of the interval join, computed without forming its pairs:
    a running count of right rows is read at the window's start (rows
    strictly before it) and at its end (rows at or before it)."""
    bucket_minutes = max(1, int(bucket_minutes))
    tol = F.expr(f"INTERVAL {int(tolerance_minutes)} MINUTES")
    rows = _timed(left, keys, left_ts).select(*keys, F.col(left_ts).alias("__lts"), F.col(left_id).alias("__lid"))
    l = (rows.select(*keys, "__lts").distinct()
             .withColumn("__b", _bucket(F.col("__lts") + tol, bucket_minutes)))
    zero = F.lit(0).cast("bigint").alias("__n")
    starts = l.select(*keys, "__b", (F.col("__lts") - tol).alias("__t"), F.lit(0).alias("__kind"),
                      F.lit(-1).alias("__sign"), zero, "__lts")
    ends = l.select(*keys, "__b", (F.col("__lts") + tol).alias("__t"), F.lit(2).alias("__kind"),
                    F.lit(1).alias("__sign"), zero, "__lts")
    r = (_timed(right, keys, right_ts).groupBy(*keys, F.col(right_ts).alias("__t"))
              .agg(F.count(F.lit(1)).alias("__n"))
              .select(*keys, "__t", "__n",
                      _copies(F.col("__t"), tolerance_minutes, bucket_minutes).alias("__b"))
              .select(*keys, "__b", "__t", F.lit(1).alias("__kind"), F.lit(0).alias("__sign"), "__n",
                      F.lit(None).cast("timestamp_ntz").alias("__lts")))
    w = (Window.partitionBy(*keys, "__b").orderBy("__t", "__kind")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marks = (starts.unionByName(ends).unionByName(r)
             .withColumn("__seen", F.sum("__n").over(w)).where(F.col("__kind") != 1)
             .groupBy(*keys, "__lts").agg(F.sum(F.col("__sign") * F.col("__seen")).alias("__m"))
             .where(F.col("__m") > 0))
    return (rows.join(marks, [*keys, "__lts"]).groupBy(F.col("__lid").alias(left_id))
                .agg(F.sum("__m").cast("bigint").alias(out)))
