"""Incremental landing: new files of a source relation are read with the
declared schema, stamped with lineage and appended to the bronze table.

Exactly-once through the file sink's log plus the checkpoint, which lives
under the session's ``spark.checkpoint.dir`` unless a path is given.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arrears.session import checkpoint_dir
from arrears.sources.schemas import struct
from arrears.sources.sink import LANDING_PARTITIONS, with_lineage


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([checkpoint_dir(spark).rstrip("/"), *parts])


def land_stream(spark: SparkSession, name: str, in_path: str, out_path: str,
                checkpoint: str | None = None, fmt_in: str = "parquet", fmt_out: str = "parquet",
                source_name: str = "operational", max_files_per_trigger: int | None = None,
                available_now: bool = True) -> StreamingQuery:
    r = spark.readStream.format(fmt_in).schema(struct(name))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = with_lineage(r.load(in_path), f"{source_name}.{name}")
    parts: list[str] = []
    if name in LANDING_PARTITIONS:
        df = df.withColumn("_day", F.to_date(LANDING_PARTITIONS[name]))
        parts = ["_day"]
    w = (df.writeStream.format(fmt_out).option("path", out_path)
           .option("checkpointLocation", checkpoint or checkpoint_path(spark, "landing", name))
           .partitionBy(*parts).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
