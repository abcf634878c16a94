"""Uniform shuffle into shards of exact size, with DataFrame functions only.

1. Rows fall into P source partitions by a hash of all their columns; a count per partition
   (P numbers) reaches the driver. Identical rows that are too many for one partition are
   counted, dealt in turn over all partitions and repeated there.
2. The driver draws the communication matrix: how many rows go from each partition to each
   destination of a uniformly random permutation (multivariate hypergeometric, exact sums
   on both sides). A destination is a slice of a shard; slices keep the second sort small
   however large a shard is.
3. The rows of a partition are numbered, so equal ones differ, and permuted locally (rank by
   a seeded hash of row and number); the rank picks the destination through the cumulative
   counts of the matrix row.
4. After the exchange each slice is permuted again, which gives the slot in the shard.

Shard sizes differ by at most one row. P follows from the number of rows (``ROWS``), not from
a setting: the same rows and seed give the same shards, in any order of input, under any
shuffle setting and after the loss of any executor.

Edge cases: null or repeated ids, and repeats of a whole row, are spread like other rows;
identical rows are interchangeable. Empty tables give an empty result. The added columns
replace input columns of the same name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import stage
from arrears.llm.hypergeometric import matrix

#: Rows of a source partition, and most of these: the matrix has about the square of their
#: number. Beyond it partitions grow; no row is left out.
ROWS, MAX_PARTITIONS = 2048, 1024
#: Identical rows beyond this part of a mean partition are dealt over all partitions.
HOT_PART = 4
#: Copies that one row becomes in a task.
CHUNK = 10_000


def _step(bounds, rank):
    """Index of the first cumulative count above ``rank``."""
    return F.size(F.filter(bounds, lambda b: b <= rank))


def _hot(keyed: DataFrame, p: int) -> DataFrame:
    """Rows of the hot hashes with their partitions: counted once per task, repeated after the exchange."""
    counted = stage(keyed.groupBy("_h", "row").agg(F.count("*").alias("n")), "shard-hot")
    before = Window.partitionBy("_h").orderBy(F.xxhash64(F.lit(1), "row")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = (counted.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
              .repartition(p, "_h", "at", "from"))
    return chunks.withColumn("k", F.explode(F.sequence(
        F.col("from"), F.least(F.col("from") + CHUNK, F.col("n")) - 1))).select(
            "row", "_h", F.pmod(F.pmod("_h", F.lit(p)) + F.col("at") + F.col("k"), F.lit(p)).cast("int").alias("_p"))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", seed: int = 42,
          partitions: int | None = None) -> DataFrame:
    """Input columns plus ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed), *columns).alias("_h"))
    copies = stage(keyed.groupBy("_h").agg(F.count("*").alias("n")), "shard-copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    p = min(MAX_PARTITIONS, max(1, partitions or -(-total // ROWS)))
    source = F.pmod("_h", F.lit(p)).cast("int")
    counts = {r[0]: r[1] for r in copies.groupBy(source.alias("p")).agg(F.sum("n")).collect()}  # at most P rows
    hot = copies.where(F.col("n") > max(1, total // (HOT_PART * p))).collect()  # at most HOT_PART * P rows
    for h, n in hot:
        counts[h % p] -= n
        for k in range(p):
            counts[k] = counts.get(k, 0) + n // p + ((k - h) % p < n % p)
    slices = -(-p // n_shards)

    sizes, starts = [], []
    for s in range(n_shards):
        size = total // n_shards + (s < total % n_shards)
        cut = [size * i // slices for i in range(slices + 1)]
        sizes += [cut[i + 1] - cut[i] for i in range(slices)]
        starts.append(cut[:-1])
    plan = []
    for k, line in enumerate(matrix([counts.get(k, 0) for k in range(p)], sizes, seed)):
        ends, at = [], 0
        for x in line:
            at += x
            ends.append(at)
        plan.append({"_p": k, "_fine": [ends[s * slices:(s + 1) * slices] for s in range(n_shards)],
                     "_coarse": ends[slices - 1::slices]})
    bounds = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(plan)), "array<struct<_p:int,_coarse:array<bigint>,_fine:array<array<bigint>>>>")))
    offsets = F.from_json(F.lit(json.dumps(starts)), "array<array<bigint>>")

    is_hot = F.col("_h").isin([r[0] for r in hot])
    dealt = keyed.withColumn("_p", source)
    if hot:
        dealt = dealt.where(~is_hot).unionByName(_hot(keyed.where(is_hot), p))
    number = Window.partitionBy("_p").orderBy("_h", F.xxhash64(F.lit(seed + 3), "row"))
    first = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed + 1), "_h", "_p", "_n"), "_n")
    second = Window.partitionBy("shard", "_slice").orderBy(F.xxhash64(F.lit(seed + 2), "_h", "_p", "_n"), "_p", "_n")
    ranked = dealt.withColumn("_n", F.row_number().over(number)).withColumn("_rank", F.row_number().over(first) - 1)
    sent = (ranked.join(F.broadcast(bounds), "_p")
            .withColumn("shard", _step(F.col("_coarse"), F.col("_rank")).cast("int"))
            .withColumn("_slice", _step(F.col("_fine")[F.col("shard")], F.col("_rank")).cast("int"))
            .select("row", "_h", "_p", "_n", "shard", "_slice"))
    slot = offsets[F.col("shard")][F.col("_slice")] + F.row_number().over(second) - 1
    return sent.withColumn("slot", slot).select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")
