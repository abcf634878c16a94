"""Where the plans get their relations from.

A ``Sources`` object hands out one DataFrame per domain relation. Two
implementations:

* ``TableSources``  - relations stored as tables (parquet by default, any
  Spark format, or JDBC queries), read with an explicit schema.
* ``DriverSources`` - relations derived from the driver's synthetic tables
  through the adapters (used by tests, the oracle check and the bench).

DataFrames are memoised per object so a plan that reads a relation twice
builds one logical sub-plan, letting Spark reuse the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrears.sources import adapters
from arrears.sources.schemas import SCHEMAS, validate


class Sources:
    spark: SparkSession

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._memo: dict[str, DataFrame] = {}

    def _load(self, name: str) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError

    def rel(self, name: str) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = self._load(name)
        return self._memo[name]

    def window(self, name: str, column: str, lo=None, hi=None) -> DataFrame:
        """``name`` rows with ``lo <= column < hi`` (either bound optional).

        When the relation is stored partitioned by the day of ``column``
        (the ``_day`` folders written by the landing), the implied bound on
        ``_day`` is added too: Spark cannot derive it from the timestamp
        filter, and with it whole day folders are pruned at planning time.
        The day bound is implied by the row bound, so rows are unchanged."""
        import datetime as dt

        from pyspark.sql import functions as F

        from arrears.sources.sink import LANDING_PARTITIONS
        df = self.rel(name)
        c = F.col(column)
        day = "_day" in df.columns and LANDING_PARTITIONS.get(name) == column

        def as_date(v):
            return v.date() if isinstance(v, dt.datetime) else v

        def lit(v):
            if isinstance(v, dt.datetime):   # zone-free timestamp literal
                return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
            return F.lit(v)

        if lo is not None:
            df = df.where(c >= lit(lo))
            if day:
                df = df.where(F.col("_day") >= F.lit(as_date(lo)))
        if hi is not None:
            df = df.where(c < lit(hi))
            if day:
                df = df.where(F.col("_day") <= F.lit(as_date(hi)))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.rel(name)


class DriverSources(Sources):
    """Domain relations built from ``{sf_dir}/{table}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _load(self, name: str) -> DataFrame:
        return adapters.build_relation(self.table, name)


class TableSources(Sources):
    """Domain relations stored one per folder / table.

    ``fmt`` is any Spark file format ("parquet", "orc", "delta" when its
    package is on the classpath). ``overrides`` maps a relation to a ready
    DataFrame, e.g. one read through JDBC with ``jdbc_query``.
    """

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet",
                 overrides: dict[str, DataFrame] | None = None):
        super().__init__(spark)
        self.base = base.rstrip("/")
        self.fmt = fmt
        for name, df in (overrides or {}).items():
            if errors := validate(df, name):
                raise ValueError(f"{name}: {'; '.join(errors)}")
            self._memo[name] = df

    def _load(self, name: str) -> DataFrame:
        return (self.spark.read.format(self.fmt).schema(SCHEMAS[name])
                .load(f"{self.base}/{name}"))


def jdbc_query(spark: SparkSession, url: str, query: str, properties: dict | None = None,
               partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Relation from a database query (a native query pushed to the server).

    ``partition=(column, lower, upper, n)`` splits the read into ``n``
    parallel range queries; only allowed with ``dbtable``, so the query is
    wrapped as a derived table then.
    """
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition is None:
        return r.option("query", query).load()
    col, lo, hi, n = partition
    return (r.option("dbtable", f"({query}) q").option("partitionColumn", col)
            .option("lowerBound", lo).option("upperBound", hi)
            .option("numPartitions", n).load())
