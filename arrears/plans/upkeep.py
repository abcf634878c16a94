"""Upkeep of the stored promise fact by changes instead of a rebuild.

A promise group never leaves its case and contact day, so a change of a promise (or of the
noted times of its case and day) touches the groups of that (case, day) and no others. The
refresh recomputes these pairs from sources cut down to them, takes over the other rows of
their days from the table, and replaces those day folders (dynamic partition overwrite). It
is a pure function of sources and table: a repeat changes nothing. Changes of users, cases or
attributes can touch any day and need a rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.config import Params
from arrears.plans import facts
from arrears.session import shared_path
from arrears.sources.catalog import Sources
from arrears.sources.sink import replace_days, write_table

col = F.col
#: Relations of the promise fact that change by case and day, and their date columns.
BY_DAY = {"ptp_overview": "contact_date", "promises_information": "contact_date", "installment": "insert_date"}


class Only(Sources):
    """A source cut down to some (case_id, day) pairs."""

    def __init__(self, src: Sources, pairs: DataFrame):
        super().__init__(src.spark)
        self.src, self.pairs = src, pairs

    def _load(self, name: str) -> DataFrame:
        df = self.src.rel(name)
        if name not in BY_DAY:
            return df
        p = self.pairs.select(col("case_id").alias("_c"), col("day").alias("_d"))
        return df.join(p, df["case_id"].eqNullSafe(p["_c"]) & (F.to_date(df[BY_DAY[name]]) == p["_d"]), "left_semi")


class With(Sources):
    """A source with some relations given."""

    def __init__(self, src: Sources, **given: DataFrame):
        super().__init__(src.spark)
        self.src = src
        self._memo.update(given)

    def _load(self, name: str) -> DataFrame:
        return self.src.rel(name)


def pairs_of(rows: DataFrame, c: str = "contact_date") -> DataFrame:
    """(case_id, day) of changed rows: give both the old and the new version of a row."""
    return rows.select("case_id", F.to_date(c).alias("day")).where(col("day").isNotNull()).distinct()


def store_fact_ptp(src: Sources, p: Params, path: str, files_per_day: int = 8) -> None:
    write_table(facts.fact_ptp(src, p), path, partition_by=["contact_date"], files_per_partition=files_per_day)


def read_fact_ptp(src: Sources, path: str) -> DataFrame:
    return src.spark.read.parquet(path).select(*facts.FACT_PTP_COLUMNS)


def refresh_fact_ptp(src: Sources, p: Params, path: str, changed: DataFrame, files_per_day: int = 8) -> None:
    """Bring the stored fact up to date after the changes in ``changed`` (case_id, day)."""
    spark = src.spark
    pairs_path, rows_path = shared_path(spark, "upkeep-pairs"), shared_path(spark, "upkeep-rows")
    changed.select("case_id", "day").distinct().write.parquet(pairs_path)
    pairs = spark.read.parquet(pairs_path)
    new = facts.fact_ptp(Only(src, pairs), p)
    old = read_fact_ptp(src, path)
    days = pairs.select(col("day").alias("_d")).distinct()
    same = pairs.select(col("case_id").alias("_c"), col("day").alias("_d"))
    kept = old.join(days, old["contact_date"] == days["_d"], "left_semi")
    kept = kept.join(same, kept["case_id"].eqNullSafe(same["_c"]) & (kept["contact_date"] == same["_d"]), "left_anti")
    # Written first: the rows are read from the folders that they replace.
    kept.unionByName(new.select(*kept.columns)).write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    replace_days(rows, path, "contact_date", files_per_day)
    _drop_empty_days(src, path, days, rows)


def _drop_empty_days(src: Sources, path: str, days: DataFrame, rows: DataFrame) -> None:
    """Folders of changed days that have no row left."""
    from arrears.sources.sink import _file_system

    held = rows.select(col("contact_date").alias("_h")).distinct()
    for (day,) in days.join(held, days["_d"] == held["_h"], "left_anti").collect():  # days, at most
        folder, fs = _file_system(src.spark, f"{path}/contact_date={day.isoformat()}")
        fs.delete(folder, True)


def fact_ptp_upkept(src: Sources, p: Params) -> DataFrame:
    """The fact stored from an older state of the promises, then brought up to date: of every
    fifty promises one was missing, one had another amount, and one more existed that is gone."""
    now, key = src.ptp_overview, F.pmod("ptp_id", F.lit(50))
    gone = now.where(key == 9).withColumn("ptp_id", -col("ptp_id")).withColumn("type", F.lit("Withdrawn"))
    amended = now.where(key != 7).withColumn("promise_capital", F.when(key == 8, col("promise_capital") + 100).otherwise(
        col("promise_capital")))
    before = amended.unionByName(gone)
    path = shared_path(src.spark, "fact-ptp")
    store_fact_ptp(With(src, ptp_overview=before), p, path, files_per_day=1)
    changed = pairs_of(now.where(key.isin(7, 8))).unionByName(pairs_of(gone)).distinct()
    refresh_fact_ptp(src, p, path, changed, files_per_day=1)
    return read_fact_ptp(src, path)
