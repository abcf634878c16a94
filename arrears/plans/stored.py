"""Reports over stored tables: facts by day with runtime pruning, and relations in buckets of
their join key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.config import Params
from arrears.plans import dims, facts
from arrears.plans.kpi import dim_date
from arrears.plans.model import Model, StoredModel
from arrears.session import shared_path
from arrears.sources.catalog import Sources
from arrears.sources.sink import write_gold, write_table

col = F.col
#: A bucket with more than this many times the mean is too hot to be one task.
HOT_BUCKET = 4


# ---- day folders pruned by a filter on a dimension
def store_star(m: Model, names: tuple[str, ...]) -> tuple[StoredModel, DataFrame]:
    """The named datasets and the calendar as tables; facts in folders of their day."""
    base = shared_path(m.src.spark, "gold")
    write_gold(m, base, names=names)
    write_table(dim_date(m), f"{base}/dim_date")
    stored = StoredModel(m.src, base, names, m.pe, m.po)
    return stored, m.src.spark.read.parquet(f"{base}/dim_date")


def calls_of_week(m: Model, week: int = 2, company: str = "ASIA") -> DataFrame:
    """Calls of one week of the month and one company. The filters stand on the calendar and
    the client alone; their days reach the scan of the fact at run time (dynamic partition
    pruning), so other day folders are never opened."""
    star, calendar = store_star(m, ("fact_dialer", "dim_client"))
    days = calendar.where(col("WeekOfMonth") == week).select("Date", "YearMonthKey")
    clients = star.dim_client.where(col("company_name") == company).select(col("client_id").alias("_cl"), "company_name")
    f = star.fact_dialer
    return (f.join(days, f["call_date"] == days["Date"]).join(clients, f["client_id"] == clients["_cl"])
             .groupBy("call_date", "YearMonthKey", "company_name")
             .agg(F.count(F.lit(1)).alias("calls"), F.sum("answered_flag").cast("bigint").alias("answered_calls")))


# ---- buckets
def hottest_bucket(df: DataFrame, key: str, buckets: int) -> float:
    """Rows of the largest bucket as a multiple of the mean."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return most * buckets / total if total else 0.0


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """A table in sorted buckets of its key, one file each: joins and sums by the key then need
    no shuffle. A table with a bucket too hot for one task stays a plain one, so that the
    adaptive join may split it."""
    spark: SparkSession = df.sparkSession
    if hottest_bucket(df, key, buckets) > max(HOT_BUCKET, buckets / 8):
        df.write.parquet(path)
        return spark.read.parquet(path)
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


class BucketedSources(Sources):
    """Relations of another source, those of ``keys`` stored in buckets of their key."""

    def __init__(self, src: Sources, keys: dict[str, str], buckets: int = 32):
        super().__init__(src.spark)
        self.src, self.keys, self.buckets = src, keys, buckets

    def _load(self, name: str) -> DataFrame:
        df = self.src.rel(name)
        if name not in self.keys:
            return df
        return write_bucketed(df, self.keys[name], self.buckets, shared_path(self.spark, f"bucketed-{name}"))


CASE_BUCKETS = dict.fromkeys(("payments", "cases", "cases_information", "case_attributes"), "case_id")


def fact_payments_bucketed(src: Sources, p: Params) -> DataFrame:
    return facts.fact_payments(BucketedSources(src, CASE_BUCKETS), p)


def dim_cases_bucketed(src: Sources, p: Params) -> DataFrame:
    return dims.dim_cases(BucketedSources(src, CASE_BUCKETS), p)
