"""Delta-maintained token totals by source, language and tokenizer version.

A change set is a table of signed rows (source, lang, tokenizer, docs, tokens): +1 and +n for
an insert, -1 and -n for a delete, both for a revised count. A commit adds up a change set and
writes the sums once under its batch id; a batch that is already committed is skipped, so a
replay after a failure changes nothing. Totals are the sum of all committed batches.

Sums are made on the map side first, so a source with a third of all rows is no hot key.

Edge cases: null sources and languages are keys of their own. Null or empty texts have no
tokens but count as documents. Repeated rows count each time. An empty change set commits an
empty batch. Groups whose documents and tokens are both zero leave the totals.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.tokens import definition, text_encoder

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def piece_counts(docs: DataFrame, tokenizer_path: str, out_col: str, text_col: str = "text") -> DataFrame:
    """Adds the number of tokens of whole texts by a file of the tokenizers library."""
    spec = definition(tokenizer_path)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encoder = text_encoder(spec)
        return pd.Series([len(x) // encoder.dtype.itemsize for x in encoder.encode([t.encode() if t else None for t in texts])], dtype="int64")

    return docs.withColumn(out_col, count(F.col(text_col)))


def rank_counts(docs: DataFrame, tokenizer_path: str, pattern: str, out_col: str, text_col: str = "text") -> DataFrame:
    """Adds the number of tokens of whole texts by a file of tiktoken ranks."""
    import base64

    with open(tokenizer_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out_col, count(F.col(text_col)))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents; ``counts`` has the key columns and ``n_tokens``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents back, with the counts they were added with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace counts (also of keys that changed)."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Committed batches under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, fs = self._path(f"batch={batch}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the batch's sums; False if it was there already. What an attempt that failed
        half-way left is overwritten."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        path, fs = self._path("")
        names = [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
        if not done:
            return self.spark.createDataFrame([], DELTA)
        return (self.spark.read.schema(DELTA).parquet(*done).groupBy(*KEYS)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 or tokens <> 0"))
