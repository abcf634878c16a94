"""Corpus pipeline: documents to a clean, deduplicated, mixed and sharded training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads back as the next stage's input. All stages but the
last return the columns of ``documents``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.common import row_keys, stage, table
from arrears.llm.curriculum import mix
from arrears.llm.decontaminate import decontaminate
from arrears.llm.queries import MAX_EPOCHS, N_SHARDS, repeating_weights
from arrears.llm.shard import shard
from arrears.llm.simhash import simhash_groups
from arrears.llm.toxicity import fit, score

#: Toxicity, fingerprints, phrase search and hash order have no SQL counterpart as a whole;
#: tests compare run() with a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the severity model rejects."""
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every component of near copies: the smallest id, and of rows that share
    it the first stored; rows without id come last. Decisions go by row, so an id may be null or
    occur in several components."""
    rows, key = row_keys(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    groups = simhash_groups(rows.select(rank.alias("rank"), "text"), "rank")
    gone = groups.where("rank.row <> component_id.row").select(F.col("rank.row").alias(key))
    return rows.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows with a benchmark passage, exact or near (its words, each as often as in the
    passage, within a few more, in any order), by row: ids may be null or shared."""
    rows, key = row_keys(docs)
    found = decontaminate(rows.select(F.col(key).alias("row"), "text"), table(spark, sf_dir, "benchmark"), "row", proximity=True)
    hit = stage(found.where(F.size("matches") > 0).select(F.col("doc_id").alias(key)), "contaminated")
    return rows.join(hit, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their weights, in training order."""
    return mix(docs, repeating_weights, max_epochs=MAX_EPOCHS).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the mix into shards of equal size."""
    return shard(docs, N_SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", drop_benchmark),
          ("mix", mix_sources), ("shard", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
