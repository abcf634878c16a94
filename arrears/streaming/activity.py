"""Daily operator activity (contacts per login and day) over a stream of
contact events: a tumbling one-day window with a watermark, so each day is
emitted once, when no more on-time events can arrive for it, and its state
is then dropped. Users are a static table joined to the finished rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import config as C
from arrears.functions.text import norm


def daily_activity(contacts: DataFrame, users: DataFrame, start: dt.date,
                   lateness: str = "1 day") -> DataFrame:
    """``contacts`` is a streaming DataFrame with the contact_events schema."""
    ce = contacts.where(F.col("target_type_id").isin(*C.CC_TARGET_TYPES)
                        & ~F.col("insert_user").isin(*C.EXCLUDED_LOGINS)
                        & (F.col("contact_date") >= F.lit(start)))
    # Watermarks need a zoned timestamp; the session zone is UTC (see
    # session.py), so the cast keeps wall-clock days and windows align to them.
    ce = ce.withColumn("_event_time", F.col("contact_date").cast("timestamp"))
    agg = (ce.withWatermark("_event_time", lateness)
             .groupBy(norm("insert_user").alias("user_name"),
                      F.window("_event_time", "1 day").alias("w"))
             .agg(F.count(F.lit(1)).alias("contact_count")))
    out = agg.select("user_name", F.to_date(F.col("w.start").cast("timestamp_ntz")).alias("contact_date"),
                     "contact_count")
    u = users.select("user_id", norm("user_name").alias("_login"))
    return (out.join(u, out["user_name"] == u["_login"], "left")
               .select("user_id", "user_name", "contact_date", "contact_count"))
