"""Best-fit decreasing packing of token sequences.

Every document becomes its token ids and an end id. A longer one than the capacity is cut into
pieces, the first of which takes the remainder, so all others fill a sequence each.

Best-fit decreasing takes the pieces by falling length and puts each into the open bin with
the least room that holds it, found in a segment tree over the rooms 1 to ``capacity``. Pieces
of one length are alike and so are bins of one room: the packing depends on how many pieces
each length has and on nothing else. So the plan is made on the driver from at most
``capacity`` counts. A leaf of the tree holds ranges of bin numbers, and one step puts a range
of pieces into a range of bins; how many steps there are depends on the capacity and not on
the number of pieces. In the cluster, pieces are numbered within their length (place in the
stored part plus the sums of the parts before), meet the step that holds their number, and
are brought together by sequence. A sequence holds at most ``capacity`` tokens, so no group
is larger than that.

Edge cases: null and empty texts are the end id alone. Null ids and repeated rows are packed
like any other. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import stage
from arrears.llm.tokens import definition, text_encoder

CAPACITY = 2048
PIECES = "part int, nth bigint, length int, doc_id bigint, piece int, start bigint, ids binary"
PLAN = "length int, first bigint, last bigint, bin bigint, offset int"
DIGEST = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, "
          "offset bigint")


class OpenBins:
    """Segment tree over rooms: a leaf holds the ranges (first bin, count) of the open bins
    with that room, an inner node whether any leaf below it holds some."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.held = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def tightest(self, least: int) -> int | None:
        """Smallest room of an open bin that is at least ``least``."""
        at = least + self.size
        while not self.held[at]:
            while at & 1:  # a right child: nothing larger under its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.size

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((first, count))
            at = room + self.size
            while at and not self.held[at]:
                self.held[at] = True
                at >>= 1

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        at = room + self.size
        if not self.ranges[room]:
            self.held[at] = False
            while at > 1 and not self.held[at ^ 1]:
                at >>= 1
                self.held[at] = False
        return out


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first, last, bin, offset): the pieces numbered first to last - 1 of a
    length go to the bins from ``bin`` on, one each, at ``offset``."""
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        piece, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins.take(room)
            # A bin that takes one piece has less room than any other and takes the next, while it can.
            each, used = room // length, min(n, left // (room // length))
            if not used:
                each, used = left, 1
            for k in range(each):
                steps.append((length, piece, piece + used, first, capacity - room + k * length))
                piece, left = piece + used, left - used
            bins.add(room - each * length, first, used)
            if room < capacity:
                bins.add(room, first + used, n - used)
            else:
                opened = first + used  # what remains is opened again
    return steps


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str,
                  text_col: str) -> DataFrame:
    """The pieces of all documents (PIECES), numbered within task and length."""
    spec = definition(tokenizer_path)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = text_encoder(spec), TaskContext.get().partitionId(), Counter()
        end, wide = np.array([end_id], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = ("part", "nth", "length", "doc_id", "piece", "start", "ids")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time as Python objects
                rows, cut = [], batch.slice(at, 256)
                texts = cut.column(1).cast(pa.binary()).to_pylist()
                for i, ids in zip(cut.column(0).to_pylist(), encoder.encode(texts)):
                    ids += end
                    n = len(ids) // wide
                    a, piece = 0, 0
                    while a < n:
                        b = a + (n - a - 1) % capacity + 1 if a == 0 else a + capacity
                        rows.append((part, seen[b - a], b - a, i, piece, a, ids[a * wide:b * wide]))
                        seen[b - a] += 1
                        a, piece = b, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces plus ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    # A row of the plan is a step over equal pieces; Spark decides by its size how to join it.
    plan = spark.createDataFrame(best_fit_plan(totals, capacity), PLAN)
    return (numbered.join(plan, (numbered.length == plan.length) & (F.col("number") >= F.col("first"))
                          & (F.col("number") < F.col("last")))
            .select("doc_id", "piece", "start", numbered.length, "ids",
                    (F.col("bin") + F.col("number") - F.col("first")).alias("sequence_id"), "offset"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Packed sequences: ``sequence_id``, ``n_tokens``, ``ids`` (little-endian integers, 16 bits
    where the vocabulary allows, else 32), ``width`` (bytes of an id) and ``pieces`` in order
    (offset, length, doc_id, piece, start)."""
    pieces = stage(encode_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "packing-pieces", "zstd")
    order = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids")))
    packed = place(pieces, capacity).groupBy("sequence_id").agg(order.alias("p"))  # at most ``capacity`` tokens
    ids = F.aggregate("p", F.expr("X''"), lambda held, x: F.concat(held, x["ids"]))
    n = F.aggregate("p", F.lit(0), lambda held, x: held + x["length"])
    return packed.select("sequence_id", n.alias("n_tokens"), ids.alias("ids"),
                         (F.octet_length(ids) / n).cast("int").alias("width"),
                         F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def piece_digests(packed: DataFrame) -> DataFrame:
    """One row per piece, read from the packed sequences (DIGEST)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence, ids, width, pieces in zip(*(batch.column(c).to_pylist()
                                                      for c in ("sequence_id", "ids", "width", "pieces"))):
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                for x in pieces:
                    a, n = x["offset"], x["length"]
                    rows.append((x["doc_id"], x["piece"], x["start"], n, zlib.crc32(wide[a:a + n].tobytes()), sequence, a))
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=[x.split()[0] for x in DIGEST.split(", ")])

    return packed.mapInArrow(run, DIGEST)
