"""Sinks: table writes with lineage, the bronze landing and the gold
(facts) materialisation.

Paths always come from the caller (a shared store on a cluster); nothing
here picks a machine-local folder.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.sources.catalog import Sources
from arrears.sources.schemas import SCHEMAS


def with_lineage(df: DataFrame, source: str) -> DataFrame:
    """Add ``_ingested_at`` (one timestamp per query) and ``_source``."""
    return df.withColumn("_ingested_at", F.current_timestamp()).withColumn("_source", F.lit(source))


#: Files that one day's folder gets at most (raise it for large days).
FILES_PER_DAY = 8
#: Formats whose overwrite deletes before it writes; others replace a table at once by themselves.
FILE_FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _clustered(df: DataFrame, parts: list[str], files_per_partition: int) -> DataFrame:
    if files_per_partition == 1:
        return df.repartition(*parts)
    slice_ = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_partition))
    return df.repartition(*parts, slice_)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Put back the table that a replacement had set aside when it was cut short; whether there was one."""
    here, fs = _file_system(spark, path)
    if fs.exists(here) or not fs.exists(here.getParent()):
        return False
    kept = [s.getPath() for s in fs.listStatus(here.getParent()) if s.getPath().getName().startswith(f"{here.getName()}.old-")]
    return bool(kept) and fs.rename(kept[0], here)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Iterable[str] = (), files_per_partition: int = FILES_PER_DAY) -> None:
    """Overwrite-style table write. Partitioning by a date column lets later
    reads prune whole folders (date filters become partition filters). Rows
    are first brought together by folder and one of ``files_per_partition``
    hash slices, so a folder gets at most that many files instead of one per
    task, and a hot day is written by as many tasks.

    An overwrite of files is written whole beside the table and then takes its
    place by renames: a write that fails leaves the old table as it was."""
    spark, parts = df.sparkSession, list(partition_by)
    if parts:
        df = _clustered(df, parts, files_per_partition)
    swap = mode == "overwrite" and fmt in FILE_FORMATS
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if swap else path
    w = df.write.format(fmt).mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.save(target)
    if swap:
        restore_table(spark, path)
        here, fs = _file_system(spark, path)
        new, old = _file_system(spark, target)[0], _file_system(spark, target.replace(".new-", ".old-"))[0]
        had = fs.exists(here)
        if had and not fs.rename(here, old) or not fs.rename(new, here):
            raise OSError(f"could not put {target} in place of {path}")
        if had:
            fs.delete(old, True)


def replace_days(df: DataFrame, path: str, day: str = "_day", files_per_day: int = FILES_PER_DAY) -> None:
    """Write rows so that the folders of the days they hold are replaced, whole, and all other
    days stay as they are (dynamic partition overwrite). The same rows again change nothing."""
    (_clustered(df, [day], files_per_day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).parquet(path))


# Date columns the raw relations are partitioned by when landed.
LANDING_PARTITIONS = {
    "contact_events": "contact_date",
    "dialer_calls": "call_date",
    "dialer_contact": "call_date",
    "payments": "payment_date",
    "ptp_overview": "promise_date",
}


def day_span(src: Sources, name: str) -> tuple[int, int, dt.date | None]:
    """Rows, days and first day of an event relation, in one pass."""
    day = F.to_date(LANDING_PARTITIONS[name])
    by_day = src.rel(name).groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    rows, days, first = by_day.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("_day"), F.min("_day")).first()
    return rows, days, first


def worth_days(src: Sources, name: str, least_rows: int) -> bool:
    """Whether a relation's days hold ``least_rows`` rows on average; below it folders by day
    would only make small files."""
    if name not in LANDING_PARTITIONS:
        return False
    rows, days, _ = day_span(src, name)
    return rows >= least_rows * days


def land_bronze(src: Sources, out_base: str, fmt: str = "parquet", source_name: str = "operational",
                relations: Iterable[str] | None = None, partition: bool = True,
                files_per_day: int = FILES_PER_DAY, least_rows_per_day: int = 0) -> list[str]:
    """Write every source relation under ``out_base/<relation>`` with lineage
    columns (the bronze layer). Event relations are partitioned by day, unless their days are
    too small (``least_rows_per_day``)."""
    written = []
    for name in relations or SCHEMAS:
        df = with_lineage(src.rel(name), f"{source_name}.{name}")
        parts: list[str] = []
        if partition and name in LANDING_PARTITIONS and (not least_rows_per_day or worth_days(src, name, least_rows_per_day)):
            c = LANDING_PARTITIONS[name]
            df = df.withColumn("_day", F.to_date(c))
            parts = ["_day"]
        write_table(df, f"{out_base.rstrip('/')}/{name}", fmt, partition_by=parts, files_per_partition=files_per_day)
        written.append(name)
    return written


def land_days(src: Sources, out_base: str, name: str, days: Iterable[dt.date], source_name: str = "operational",
              files_per_day: int = FILES_PER_DAY) -> None:
    """Land some days of an event relation again. Their folders are replaced; a day without
    rows by now loses its folder; no other day is read or written."""
    c, days = LANDING_PARTITIONS[name], sorted(set(days))
    if not days:
        return
    spark, path = src.spark, f"{out_base.rstrip('/')}/{name}"
    rows = src.window(name, c, days[0], days[-1] + dt.timedelta(days=1)).withColumn("_day", F.to_date(c))
    rows = with_lineage(rows.where(F.col("_day").isin(days)), f"{source_name}.{name}")
    folders = {day: _file_system(spark, f"{path}/_day={day.isoformat()}") for day in days}

    def files(folder, fs) -> set[str]:
        return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()

    before = {day: files(*folders[day]) for day in days}
    replace_days(rows, path, files_per_day=files_per_day)
    for day, (folder, fs) in folders.items():
        if before[day] and files(folder, fs) == before[day]:  # the write had no rows for it
            fs.delete(folder, True)


# Dataset -> partition column for the gold layer.
GOLD_PARTITIONS = {
    "fact_dialer": "call_date",
    "fact_contacts": "contact_date",
    "fact_payments": "payment_date",
    "fact_ptp": "contact_date",
    "fact_ptp_enriched": None,
    "cc_operator_activity": "contact_date",
    "fact_operator_presence": "WorkDate",
    "dim_operators": None,
    "dim_cases": None,
    "dim_client": None,
    "dim_company": None,
    "dim_commission_rules": None,
}


def write_gold(model, out_base: str, fmt: str = "parquet", names: Iterable[str] | None = None) -> list[str]:
    """Materialise facts and dimensions as tables. Later reports read these instead of
    recomputing the facts from raw relations; the written table is also the
    lineage cut (a lost executor recomputes from the table, not the raw
    history)."""
    done = []
    for name in names or GOLD_PARTITIONS:
        part = GOLD_PARTITIONS.get(name)
        write_table(getattr(model, name), f"{out_base.rstrip('/')}/{name}", fmt,
                    partition_by=[part] if part else [])
        done.append(name)
    return done


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count, column_count) for many tables in one job."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        out = part if out is None else out.unionByName(part)
    return out
