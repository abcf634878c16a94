"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule w(t) = w0 + (w1 - w0) t on training time [0, 1]. Its
integral is the source's weight; targets share the total size by weight, stop at
``max_epochs`` times the size of their source, and pass the excess on by weight (water
filling in closed form: sort sources by cap over weight, prefix sums, one level for the
rest). A document's place in the cumulative token demand of its source, inverted through
the integrated schedule, is its training position; the mix is range-sorted by position.

The prefix sums over a source are made from sums of 4096 hash buckets, so a source with a
third of all rows is spread over 4096 groups. Order inside a source is the MD5 of the seed
and the id, then id and size: reruns agree, in any engine. Rows of equal id and size are
dealt into ``SUBS`` parts by stored row and added up first, so that an id (or null) with a
third of all rows comes to a bucket as sums, and its rows are placed part by part.

Edge cases: a null or blank text has size 0; like any document it is taken at most
``max_epochs`` times, rounded up, and adds no words. A null source is a source of its own,
last in order. A null id hashes as the empty string; repeated ids are ordered by size. In the
mix every row has a key of its own, so rows with null or repeated ids are taken like any other,
each by its own epochs. An empty table gives an empty mix. Columns added by the operator
replace input columns of the same name.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import row_keys, stage

#: Words that count towards size.
SIZE_WORD = r"[^\x20\x09-\x0D]+"
BUCKET_HEX = 3
#: Parts of the rows with one id and size.
SUBS = 64


def word_size(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """(source, source_size, weight, ...) -> plus ``target`` (double).

    ``sources`` holds one row per source, so its windows are small.
    """
    size = F.col("source_size").cast("double")
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sources.withColumn("cap", size * max_epochs)
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("total", F.sum(size).over(everyone))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / F.sum("weight").over(onward))
            .withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
            .withColumn("share", F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(everyone))
            .withColumn("target", F.when(F.col("full"), F.col("cap"))
                        .otherwise(F.col("weight") * F.col("share.level")))
            .drop("cap", "ratio", "total", "level", "full", "share"))


def demand_time(u: Column, w0: Column, w1: Column) -> Column:
    """Training time at which a fraction ``u`` of the integrated schedule is consumed."""
    area = (w0 + w1) / 2
    root = F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) * u * area, F.lit(0.0)))
    return F.when(u <= 0, F.lit(0.0)).otherwise(F.least(2 * u * area / (w0 + root), F.lit(1.0)))


def assign(docs: DataFrame, schedule, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted),
    epochs (times taken) and position (training time of the first use; null if unused).

    ``schedule(rank)`` gives the Columns (w0, w1) for a source's rank by code point.
    """
    rows, key = row_keys(docs)
    sized = stage(_sized(rows, key, id_col, text_col, source_col, seed), "mix-sizes")
    return _place(sized, schedule, max_epochs).drop("row").withColumnRenamed("id", id_col)


def _sized(rows: DataFrame, key: str, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """id, source, size, key, row (stored row), bucket and sub of every row."""
    return rows.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_size(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("key"), F.col(key).alias("row"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_HEX)).withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(SUBS)))


def _place(sized: DataFrame, schedule, max_epochs: float) -> DataFrame:
    """``assign`` of rows from ``_sized``, with their ``row``."""
    alike = ["source", "bucket", "key", "id", "size", "sub"]
    groups = stage(sized.groupBy(*alike).agg(F.sum("size").alias("group_size")), "mix-groups")
    buckets = stage(groups.groupBy("source", "bucket").agg(F.sum("group_size").alias("bucket_size")), "mix-buckets")
    by_source = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    ranked = by_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w0, w1 = schedule(F.col("rank"))
    ranked = ranked.withColumn("w0", w0.cast("double")).withColumn("w1", w1.cast("double"))
    targets = water_fill(ranked.withColumn("weight", (F.col("w0") + F.col("w1")) / 2), max_epochs)

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).alias("b")
    starts = starts.join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.source", "b.bucket", "start", "source_size", "target", "w0", "w1")

    before = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "sub").rowsBetween(
        Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("group_size").over(before), F.lit(0))).alias("g").join(
        starts.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")) & (F.col("g.bucket") == F.col("s.bucket"))).select(
            *[F.col(f"g.{c}") for c in alike], "before", "start", "source_size", "target", "w0", "w1")
    groups = stage(groups, "mix-placed").alias("g")
    placed = sized.alias("d").join(groups, (F.col("d.bucket") == F.col("g.bucket")) & (F.col("d.key") == F.col("g.key"))
                                   & (F.col("d.size") == F.col("g.size")) & (F.col("d.sub") == F.col("g.sub"))
                                   & F.col("d.source").eqNullSafe(F.col("g.source")) & F.col("d.id").eqNullSafe(F.col("g.id")))
    placed = placed.select("d.*", "before", "start", "source_size", "target", "w0", "w1")
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("row")) - 1
    placed = placed.withColumn("ahead", F.col("before") + F.col("size") * nth)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    at = F.col("start") + F.col("ahead")
    rest = F.col("target") - F.col("full") * F.col("source_size")
    first = F.when(F.col("target") > 0, F.least(at / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return (placed.withColumn("full", full.cast("long"))
            .withColumn("epochs", F.least(F.col("full") + F.when(at + F.col("size") / 2 <= rest, 1).otherwise(0),
                                           F.lit(ceil(max_epochs))))
            .withColumn("position", F.when(F.col("epochs") > 0, demand_time(first, F.col("w0"), F.col("w1"))))
            .select("id", "source", "size", "source_size", "target",
                    (F.col("size") * F.col("epochs")).alias("taken"), F.col("epochs").cast("int").alias("epochs"),
                    "position", at.alias("offset"), "w0", "w1", "row"))


def expand(assigned: DataFrame) -> DataFrame:
    """One row per use of a document: adds ``epoch`` and the use's own ``position``."""
    used = assigned.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    at = F.col("offset") + F.col("epoch") * F.col("source_size")
    u = F.when(F.col("target") > 0, F.least(at / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    return used.withColumn("position", demand_time(u, F.col("w0"), F.col("w1")))


def mix(docs: DataFrame, schedule, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The training mix: every input column of each used row, once per use, with ``epoch`` and
    ``position``. Sizes and uses go by a key of the stored row, never by its id."""
    names = [c for c in docs.columns if c not in ("epoch", "position")]
    rows, key = row_keys(docs.select(*[f"`{c}`" for c in names]) if len(names) < len(docs.columns) else docs)
    sized = stage(_sized(rows, key, id_col, text_col, source_col, seed), "mix-sizes")
    uses = stage(expand(_place(sized, schedule, max_epochs)).select(F.col("row").alias(key), "epoch", "position"), "mix-uses")
    return rows.join(uses, key).drop(key).orderBy("position", id_col, "epoch")
