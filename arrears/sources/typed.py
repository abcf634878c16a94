"""Typed reading of text files with a table of rejects.

A line is parsed twice in one pass: as texts and by the declared types, both permissively. A
cell that holds a text and has no typed value is bad; a line without the declared number of
fields is bad as a whole. Rows without a bad cell are accepted; every bad cell of the others
is a reject with its column, its text and the reason. Nothing turns into a null unseen:
accepted and rejected rows together are the rows read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def typed(lines: DataFrame, schema: StructType | str, sep: str = ",", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Lines plus ``row`` (typed fields) and ``bad`` (array of column_name, value, reason)."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "dateFormat": date_format}
    corrupt = StructField(CORRUPT, StringType())
    texts = StructType([*[StructField(f.name, StringType()) for f in schema], corrupt])
    parsed = lines.withColumn("text", F.from_csv("line", texts.simpleString()[7:-1].replace(":", " "), options)).withColumn(
        "typed", F.from_csv("line", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema, corrupt]), options))
    cells = F.array(*[F.when(F.col(f"text.{f.name}").isNotNull() & F.col(f"typed.{f.name}").isNull(),
                             F.struct(F.lit(f.name).alias("column_name"), F.col(f"text.{f.name}").alias("value"),
                                      F.lit(f"no {f.dataType.simpleString()}").alias("reason"))) for f in schema])
    whole = F.array(F.struct(F.lit("").alias("column_name"), F.col("line").alias("value"),
                             F.lit("not the declared fields").alias("reason")))
    bad = F.when(F.col(f"text.{CORRUPT}").isNotNull(), whole).otherwise(F.filter(cells, lambda c: c.isNotNull()))
    return parsed.select("file", "line", F.struct(*[F.col(f"typed.{f.name}") for f in schema]).alias("row"), bad.alias("bad"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("bad") == 0).select("row.*")


def rejects(parsed: DataFrame) -> DataFrame:
    """(file, line, column_name, value, reason): one row per bad cell."""
    return parsed.select("file", "line", F.inline("bad"))


def load_report(parsed: DataFrame) -> DataFrame:
    """(outcome, column_name, reason, n): rows read, accepted and rejected, and bad cells by column and reason."""
    ok = F.size("bad") == 0
    kinds = F.array(F.struct(F.lit("read").alias("outcome"), F.lit("").alias("column_name"), F.lit("").alias("reason")),
                    F.struct(F.when(ok, "accepted").otherwise("rejected").alias("outcome"), F.lit("").alias("column_name"),
                             F.lit("").alias("reason")))
    cells = F.transform("bad", lambda c: F.struct(F.lit("cell").alias("outcome"), c["column_name"].alias("column_name"),
                                                  c["reason"].alias("reason")))
    return parsed.select(F.inline(F.concat(kinds, cells))).groupBy("outcome", "column_name", "reason").agg(
        F.count(F.lit(1)).alias("n"))
