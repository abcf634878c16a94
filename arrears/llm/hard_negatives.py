"""Hard negatives by inner product over STR-packed R-trees.

Vectors are cut into slabs by their first coordinate (a range partitioning) and each task packs
blocks of at most ``BLOCK`` rows into R-trees by sort-tile-recursive: sort by the coordinate of
the widest spread, cut, sort each cut by the next one, until a tile fits a leaf; ``FAN``
consecutive boxes get a box above them. A tree is one row of a stored table.

For an anchor q a box [lo, hi] bounds every inner product in it: coordinate by coordinate it
lies between min and max of q * lo and q * hi, and the sums of these are the bounds. A search takes
boxes from a queue by highest upper bound, skips those wholly outside the score windows, and
ends when the next box is strictly below the k-th score found (equal ones may still hold
smaller ids). The first pass finds every anchor's positives; their scores give the windows
of the second, which finds the negatives of all positives of an anchor in one walk.

Trees and blocks of ``ANCHORS`` anchors meet by an equi-join on a group number of trees, so
each tree moves once and the anchors, the smaller side, are repeated. A task reports at most k rows
for an anchor, tree and window; the best of all trees are taken by rank.

Components become integers (floor of ``scale`` times the value, at most 2 ** 26 in size), and
scores are exact: sums are made in doubles where they stay under 2 ** 53, else in integers.

Edge cases: rows without id, label or vector, or with a null or non-finite component, take no
part. Of vectors of different lengths the common coordinates count (missing ones are zero). Rows that share
an id are rows of their own: an anchor may have a row of its own id as a positive. Ties go by
id, then by stored row. An anchor without positives, or a positive without a row in its window,
gives no row; no window holds a score where the positive's score is below zero. Empty tables give an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import row_keys, stage

BLOCK, LEAF, FAN = 8192, 128, 8
ANCHORS = 256
LARGEST = 1 << 26
TREE = "tree bigint, width int, rows binary, ids binary, labels binary, vectors binary, lows binary, highs binary"


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
            label: Column | None = None, scale: int = 256) -> DataFrame:
    """(row, id, label, v): the rows that take part, with integer components."""
    rows, key = row_keys(vectors)
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    integer = F.transform(vector_col, lambda x: F.greatest(F.lit(-LARGEST), F.least(
        F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int"))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole).select(
        F.col(key).alias("row"), F.col(id_col).cast("long").alias("id"),
        (F.col(label_col) if label is None else label).cast("long").alias("label"), integer.alias("v"))


# ---- trees

def _tiles(v: np.ndarray, rows: np.ndarray, order: np.ndarray, k: int) -> list[np.ndarray]:
    """Sort-tile-recursive: rows in tiles of at most LEAF."""
    tiles = -(-rows.size // LEAF)
    if tiles <= 1:
        return [rows]
    left = max(1, order.size - k)
    slabs = max(2, int(np.ceil(tiles ** (1 / left))))
    rows = rows[np.argsort(v[rows, order[k % order.size]], kind="stable")]
    size = -(-tiles // slabs) * LEAF
    return [t for a in range(0, rows.size, size) for t in _tiles(v, rows[a:a + size], order, k + 1)]


def levels(n: int) -> list[int]:
    """Number of boxes of each level, leaves first, of a tree over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def str_pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row order, ends of the leaves in it, and lows and highs of the boxes, level by level."""
    order = np.argsort(-v.std(axis=0), kind="stable") if v.shape[1] else np.zeros(1, np.int64)
    tiles = _tiles(v, np.arange(len(v)), order, 0) if v.shape[1] else [
        np.arange(a, min(a + LEAF, len(v))) for a in range(0, len(v), LEAF)]
    lows, highs = [np.array([v[t].min(axis=0) for t in tiles])], [np.array([v[t].max(axis=0) for t in tiles])]
    while len(lows[-1]) > 1:
        cuts = np.arange(0, len(lows[-1]), FAN)
        lows.append(np.minimum.reduceat(lows[-1], cuts, axis=0))
        highs.append(np.maximum.reduceat(highs[-1], cuts, axis=0))
    return np.concatenate(tiles), np.cumsum([t.size for t in tiles]), np.concatenate(lows), np.concatenate(highs)


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Equal-length rows; missing components are zero."""
    out = np.zeros((len(vectors), width), dtype=np.int32)
    for k, x in enumerate(vectors):
        out[k, :len(x)] = x
    return out


def build_trees(rows: DataFrame) -> DataFrame:
    """Stored R-trees over prepared rows."""

    def pack(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def tree(part: pa.Table) -> pa.RecordBatch:
            lists = part.column("v").to_pylist()
            v = _matrix(lists, max(map(len, lists)))
            order, ends, lows, highs = str_pack(v)
            number = lambda c: part.column(c).to_numpy()[order].astype("<i8")
            own = number("row")
            return pa.RecordBatch.from_pylist([{
                "tree": int(own.min()), "width": v.shape[1], "rows": own.tobytes(), "ids": number("id").tobytes(),
                "labels": number("label").tobytes(), "vectors": v[order].astype("<i4").tobytes(),
                "lows": lows.astype("<i4").tobytes(), "highs": highs.astype("<i4").tobytes(),
                "ends": ends.astype("<i8").tobytes()}], schema)

        schema = pa.schema([("tree", pa.int64()), ("width", pa.int32())] + [
            (c, pa.binary()) for c in ("rows", "ids", "labels", "vectors", "lows", "highs", "ends")])
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                whole = pa.Table.from_batches(held)
                yield tree(whole.slice(0, BLOCK))
                held, n = whole.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield tree(pa.Table.from_batches(held))

    first = F.coalesce(F.get("v", 0), F.lit(0))
    slabs = rows.repartitionByRange(first, F.xxhash64("row")).sortWithinPartitions(first, F.xxhash64("row"))
    return stage(slabs.mapInArrow(pack, TREE + ", ends binary"), "rtrees")


class RTree:
    """One stored tree, for searches by a block of anchors."""

    def __init__(self, row: dict, anchors: np.ndarray):
        width = row["width"]
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("rows", "ids", "labels"))
        ends = np.frombuffer(row["ends"], "<i8").tolist()
        self.spans = list(zip([0, *ends[:-1]], ends))
        self.sizes = levels(len(ends))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        low, high, v = (np.frombuffer(row[c], "<i4").reshape(-1, width) for c in ("lows", "highs", "vectors"))
        common = min(width, anchors.shape[1])
        low, high, v, q = low[:, :common], high[:, :common], v[:, :common], anchors[:, :common]
        largest = max(1, int(np.abs(v.astype(np.int64)).max(initial=0))) * max(1, int(np.abs(q.astype(np.int64)).max(initial=0)))
        kind = np.float64 if largest * max(1, common) < 1 << 53 else np.int64
        low, high, self.v, self.q = (x.astype(kind) for x in (low, high, v, q))
        above, below = np.maximum(self.q, 0), np.minimum(self.q, 0)
        #: Bounds of the inner products of every anchor with every box.
        self.upper = above @ high.T + below @ low.T
        self.lower = above @ low.T + below @ high.T

    def walk(self, anchor: int, wanted, floor):
        """Leaves (their first and last row and the scores in between) by falling upper bound.
        ``wanted(lower, upper)`` tells whether a box may hold a row; ``floor()`` is the lowest score
        that still counts."""
        upper, lower, q = self.upper[anchor].tolist(), self.lower[anchor].tolist(), self.q[anchor]
        top = len(self.sizes) - 1
        queue = [(-upper[self.starts[top]], top, 0)]
        while queue:
            bound, level, k = heapq.heappop(queue)
            if -bound < floor():  # strictly: an equal score may have a smaller id
                return
            at = self.starts[level] + k
            if not wanted(lower[at], upper[at]):
                continue
            if level == 0:
                a, b = self.spans[k]
                yield a, b, self.v[a:b] @ q
                continue
            below, end = self.starts[level - 1], min((k + 1) * FAN, self.sizes[level - 1])
            for j in range(k * FAN, end):
                heapq.heappush(queue, (-upper[below + j], level - 1, j))

    def _best(self, held: list, places: np.ndarray, scores: np.ndarray, k: int) -> list:
        """The best k of held and new rows as (-score, id, row)."""
        new = zip((-scores).astype(np.int64).tolist(), self.ids[places].tolist(), self.rows[places].tolist())
        return sorted([*held, *new])[:k]

    def positives(self, anchor: int, row: int, label: int, k: int) -> list:
        """The k best other rows of the label."""
        best: list = []
        floor = lambda: -best[-1][0] if len(best) == k else -np.inf
        for a, b, s in self.walk(anchor, lambda low, high: True, floor):
            m = np.nonzero((s >= floor()) & (self.labels[a:b] == label) & (self.rows[a:b] != row))[0]
            if m.size:
                best = self._best(best, a + m, s[m], k)
        return best

    def negatives(self, anchor: int, label: int, windows: list[tuple[int, int]], k: int) -> list[list]:
        """For every window (lowest and highest score) the k best rows of other labels in it."""
        best: list[list] = [[] for _ in windows]
        floors = [low for low, _ in windows]

        def wanted(low, high):
            return any(high >= f and low <= w[1] for f, w in zip(floors, windows))

        for a, b, s in self.walk(anchor, wanted, lambda: min(floors)):
            other = self.labels[a:b] != label
            for j, (_, high) in enumerate(windows):
                m = np.nonzero((s >= floors[j]) & (s <= high) & other)[0]
                if m.size:
                    best[j] = self._best(best[j], a + m, s[m], k)
                    if len(best[j]) == k:
                        floors[j] = max(floors[j], -best[j][-1][0])
        return best


# ---- searches

def _meet(trees: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every tree beside every block of anchors: the block's rows are repeated for each group of
    trees, about one tree each. Spark takes the repeated blocks for as few bytes as the blocks had
    and would broadcast them through the driver, so the join is a merge of shuffled rows; it
    holds the trees of one group at a time and passes the blocks by."""
    n_trees, n_anchors = trees.count(), anchors.count()
    groups, blocks = max(1, n_trees), max(1, -(-n_anchors // ANCHORS))
    block = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").agg(
        F.collect_list(F.struct(*anchors.columns)).alias("anchors"))  # about ANCHORS rows
    each = block.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "anchors")
    grouped = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
    return each.join(grouped.hint("merge"), "g").drop("g")


def _search(pairs: DataFrame, find, columns: str) -> DataFrame:
    """Run ``find(tree, k, anchor)``, which gives rows, for every anchor and tree of the pairs."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                anchors = row["anchors"]
                tree = RTree(row, _matrix([a["v"] for a in anchors], max(len(a["v"]) for a in anchors)))
                out = [x for k, a in enumerate(anchors) for x in find(tree, k, a)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                                 [pa.array([], pa.int64())] * len(names), names=names)

    return pairs.mapInArrow(run, columns)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """Prepared rows -> anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. A negative's score lies between ``low`` and ``high`` percent of the
    positive's."""
    rows = stage(rows, "vectors")
    trees, anchors = build_trees(rows), rows.where(is_anchor)

    def own(tree, k, a):
        return [(a["row"], -s, i, r) for s, i, r in tree.positives(k, a["row"], a["label"], positives)]

    found = _search(_meet(trees, anchors), own, "anchor bigint, score bigint, id bigint, row bigint")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    chosen = stage(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives), "positives")

    scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("scores"))
    asking = stage(anchors.join(scores, anchors.row == scores.anchor).drop("anchor"), "anchors")

    def other(tree, k, a):
        windows = [(-(-low * x["score"] // 100), high * x["score"] // 100) for x in a["scores"]]
        for x, held in zip(a["scores"], tree.negatives(k, a["label"], windows, negatives)):
            for s, i, r in held:
                yield a["row"], x["nth"], -s, i, r

    found = _search(_meet(trees, asking), other, "anchor bigint, nth bigint, score bigint, id bigint, row bigint")
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = chosen.select("anchor", F.col("nth").cast("long").alias("nth"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score")).join(names, "anchor")
    return ranked.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(
        pairs, ["anchor", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                         "negative_id", "positive_score", "negative_score")
