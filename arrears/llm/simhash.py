"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected components.

A fingerprint has bit b set if more than half of the shingles' XXH64 hashes have it. Distinct
fingerprints are compared exactly, in tiles. A tile is the set of fingerprints whose four
16-bit words have given population counts. A differing bit changes one count by one, so two
fingerprints within the radius r lie in tiles whose counts differ by r in sum at most; all
other tile pairs are skipped. The tiles that remain are cut into blocks of about
``BLOCK`` fingerprints and compared by numpy exclusive-or and bit counts.

Each block pair reports a spanning forest of its links, not the links: connectivity is kept
and the output is linear in the block, however dense a group of copies is. Components of the
forest come from alternating large-star and small-star steps over tables in the shared folder.

Edge cases: null or blank texts have fingerprint zero and link like any other; texts with
fewer words than the shingle are one shingle. Repeated rows share fingerprint and component.
Null ids are carried along and never name a component unless all its ids are null. Empty
tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import chunks, stage

SHINGLE, RADIUS, SEED = 3, 2, 42
WORDS16 = 4
BLOCK = 2048


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased word shingles; 0 without words."""
    parts = chunks(text)
    if not parts:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(parts) < size:
        return hashed(b" ".join(parts), SEED)
    h = np.fromiter((hashed(b" ".join(s), SEED) for s in zip(*(parts[k:] for k in range(size)))),
                    dtype="<u8", count=len(parts) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, h.size, 65536):
        bits = np.unpackbits(h[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def _tile():
    """Tile number: population counts of the four 16-bit words in base 17."""
    key = F.lit(0)
    for k in range(WORDS16):
        word = F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
        key = key * 17 + F.bit_count(word)
    return key.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts within the radius, one of each opposite pair, without zero."""
    near = (d for d in product(range(-radius, radius + 1), repeat=WORDS16) if 0 < sum(map(abs, d)) <= radius)
    return [d for d in near if d > (0,) * WORDS16]


def _forest(links_a: np.ndarray, links_b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[links_a], label[links_b])
        new = label.copy()
        np.minimum.at(new, links_a, low)
        np.minimum.at(new, links_b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two blocks within the radius."""
    left, right = [], []
    for k in range(0, a.size, 256):
        x, y = np.nonzero(np.bitwise_count(a[k:k + 256, None] ^ b[None, :]) <= radius)
        left.append(x + k)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest that connects the distinct fingerprints within the radius."""
    tiled = prints.select("fp", _tile().alias("tile"))
    cuts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("cuts"))
    blocks = stage(
        tiled.join(cuts, "tile")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("cuts")))
        .groupBy("tile", "part").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")

    steps, inside = [], []
    for d in _offsets(radius):
        step = 0
        for x in d:
            step = step * 17 + x
        steps.append(step)
        inside.append(d)
    near = F.array(*[F.struct(F.lit(s).alias("step"), *[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)])
                     for s, d in zip(steps, inside)])
    count = [F.pmod(F.floor(F.col("tile") / 17 ** (WORDS16 - 1 - k)), F.lit(17)) for k in range(WORDS16)]
    reach = blocks.select("tile", "part", F.explode(near).alias("n"))
    for k, c in enumerate(count):
        reach = reach.where((c + F.col(f"n.d{k}")).between(0, 16))
    there = blocks.select("tile", "part")
    reach = reach.select("tile", "part", (F.col("tile") + F.col("n.step")).alias("other")).join(
        there.select(F.col("tile").alias("other"), F.col("part").alias("other_part")), "other")
    own = there.alias("x").join(there.alias("y"), "tile").where("x.part <= y.part").select(
        "tile", F.col("x.part").alias("part"), F.col("tile").alias("other"), F.col("y.part").alias("other_part"))
    pairs = reach.select("tile", "part", "other", "other_part").unionByName(own)
    both = pairs.join(blocks, ["tile", "part"]).join(
        blocks.select(F.col("tile").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("fps_b")),
        ["other", "other_part"]).select("fps", "fps_b")

    def compare(batches):
        for batch in batches:
            one, two = batch.column(0), batch.column(1)
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                a = one[k].values.to_numpy().view(np.uint64)
                b = two[k].values.to_numpy().view(np.uint64)
                x, y = tile_links(a, b, radius)
                values = np.concatenate([a, b])
                distinct, place = np.unique(values, return_inverse=True)
                root = _forest(place[x], place[a.size + y], distinct.size)
                moved = np.nonzero(root != np.arange(distinct.size))[0]
                out_a.append(distinct[moved].view(np.int64))
                out_b.append(distinct[root[moved]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64())
                                              for v in (out_a, out_b)], names=["a", "b"])

    return both.mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable. Alternating large-star and small-star
    steps; every round is a table in the shared folder."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        # Minima are tables: both sides of the joins are then exchanged, and a hub is split.
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "links")
        small_least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stage(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id
    reachable through links of at most ``radius`` differing bits)."""
    rows = stage(fingerprints(docs, id_col, text_col, size), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    roots = components(links(prints.select("fp"), radius))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(rooted.join(low, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
