"""Registered queries of the training-data operators, with oracle SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import oracle
from arrears.llm.common import fresh_path, stage, table
from arrears.llm.curriculum import assign
from arrears.llm.decontaminate import decontaminate, digest
from arrears.llm.exact_dedup import exact_dedup
from arrears.llm.hard_negatives import hard_negatives, prepare
from arrears.llm.license_scan import license_scan
from arrears.llm.lm_score import lm_scores
from arrears.llm.merkle import manifest
from arrears.llm.packing import pack, piece_digests
from arrears.llm.shard import shard
from arrears.llm.simhash import simhash_groups
from arrears.llm.token_file import read_documents, starts, write_token_files
from arrears.llm.token_rollup import Rollup, deletes, inserts, piece_counts, rank_counts, revisions
from arrears.llm.toxicity import fit, score

N_SHARDS = 40
MAX_EPOCHS = 3.0


def repeating_weights(rank):
    """Weights 1, 2, 3, repeating over the sources. The schedule of every second source falls
    from 3/2 to 1/2 of its weight, that of the others rises; the integral is the weight."""
    weight = (F.pmod(rank, F.lit(3)) + 1).cast("double")
    falling = F.pmod(rank, F.lit(2)) == 0
    return (F.when(falling, weight * 1.5).otherwise(weight * 0.5),
            F.when(falling, weight * 0.5).otherwise(weight * 1.5))


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return digest(decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"), proximity=True))


def op2_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    index = write_token_files(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return starts(read_documents(index, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    found = license_scan(table(spark, d, "documents").select("doc_id", "text"))
    s = F.col("licenses")
    return found.select(
        "doc_id", s["n_words"].alias("n_words"), s["n_base"].alias("n_base"), s["first_word"].alias("first_word"),
        s["last_word"].alias("last_word"), F.concat_ws(",", s["base_labels"]).alias("base_labels"),
        F.concat_ws(",", s["labels"]).alias("labels"), s["score"].alias("score"),
        F.size(s["spans"]).cast("long").alias("n_spans"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = fit(docs, table(spark, d, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "toxic_probability", "rejected")


def op5_token_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals after four batches: all documents counted by the first tokenizer; later exact
    copies taken out; counts revised to include an end token; the rest counted by a second
    tokenizer. Each batch is then sent once more, which must change nothing."""
    counted = piece_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), "n_first")
    counted = rank_counts(counted, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "n_second")
    counted = stage(counted.select("doc_id", "source", "lang", "n_first", "n_second",
                                   F.md5(F.coalesce("text", F.lit(""))).alias("h")), "token-counts")
    first = counted.withColumn("tokenizer", F.lit("word_bpe_49k")).withColumnRenamed("n_first", "n_tokens")
    # A table of its own, so that both sides of the join are exchanged and a hot hash is split.
    kept = stage(counted.groupBy("h").agg(F.min("doc_id").alias("keep_id")), "token-kept")
    tagged = stage(first.join(kept, "h").withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("keep_id"))), "token-tags")
    live = tagged.where("not copy")
    batches = {
        "1-load": inserts(first),
        "2-drop-copies": deletes(tagged.where("copy")),
        "3-end-token": revisions(live, live.withColumn("n_tokens", F.col("n_tokens") + 1)),
        "4-second-tokenizer": inserts(live.drop("n_tokens", "tokenizer").withColumn("tokenizer", F.lit("byte_bpe_50k"))
                                      .withColumnRenamed("n_second", "n_tokens")),
    }
    rollup = Rollup(spark, fresh_path(spark, "token-rollup"))
    for batch, changes in [*batches.items(), *batches.items()]:
        rollup.commit(batch, changes)
    return rollup.totals()


def op6_mix(spark: SparkSession, d: str) -> DataFrame:
    placed = stage(assign(table(spark, d, "documents"), repeating_weights, max_epochs=MAX_EPOCHS), "mix")
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op7_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return lm_scores(table(spark, d, "documents"), good)


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_groups(table(spark, d, "documents"))


def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents"))


def op10_shard(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(rows, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return piece_digests(pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepare(table(spark, d, "embeddings"), label=label), F.col("id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every second document, by the checksum of its id, is checked after it lost its line ends."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    siblings = F.transform("steps", lambda s: F.concat(s["left"], s["right"]))
    return manifest(table(spark, d, "documents"), changed).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_token_files, op3_license_scan, op4_toxicity, op5_token_rollup, op6_mix,
    op7_lm_scores, op8_simhash, op9_exact_dedup, op10_shard, op11_best_fit_packing, op12_hard_negatives,
    op13_merkle_manifest)}
ORACLE_SQL = {"op1_decontaminate": oracle.DECONTAMINATE, "op6_mix": oracle.MIX, "op9_exact_dedup": oracle.EXACT_DEDUP,
              "op12_hard_negatives": oracle.HARD_NEGATIVES, "op13_merkle_manifest": oracle.merkle()}
