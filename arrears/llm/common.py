"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte map of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z:
#: digits, a-z and every non-ASCII byte stay, A-Z become a-z, the rest becomes a space.
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32
    for i in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def chunks(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder serves a local session; a cluster must set it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a row key for the place in a file; the others number the files.
ROW_BITS = 40
#: A list of files up to this size is broadcast.
FILE_LIST_BYTES = 8 << 20


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores where a column of the frame has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of each stored row (long), and the key's name, which no column has:
    the number of its file and its place there. The same in every read, however often ids or
    whole rows repeat. A frame that is not read straight from files is stored first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stage(docs, "rows")
    key, path, base = (free_name(docs, x) for x in ("_row", "_path", "_base"))
    stored = docs.metadataColumn("_metadata")
    placed = docs.select("*", stored["file_path"].alias(path), stored["row_index"].alias(key))
    # As the rows name their files: without the empty host of a path's URI.
    files = sorted({re.sub(r"^([^:/]+):///", r"\1:/", f) for f in docs.inputFiles()})
    numbers = docs.sparkSession.createDataFrame([(f, k << ROW_BITS) for k, f in enumerate(files)],
                                                f"`{path}` string, `{base}` bigint")
    if sum(map(len, files)) < FILE_LIST_BYTES:  # beyond that Spark joins it as it sees fit
        numbers = F.broadcast(numbers)
    known = F.coalesce(F.col(base), F.raise_error(F.concat(F.lit("unknown file "), F.col(path))).cast("bigint"))
    return placed.join(numbers, path, "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], (known + F.col(key)).alias(key)), key


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder the driver has it in (a cluster
    that installs the package or ships it with --py-files finds it there as well)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
