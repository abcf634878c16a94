"""Hard negatives over R-trees against all scores."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arrears.llm import hard_negatives as hn
from arrears.llm.common import stage
from arrears.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row string, id string, v string, _row string, _metadata string"


def vectors(seed, n, width, spread):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    out = []
    for k in range(n):
        c = rng.choice(centers)
        out.append((k, [x + rng.gauss(0, spread) for x in c], rng.randrange(3)))
    same = out[5]
    out += [(n + k, same[1], k % 3) for k in range(n // 3)]  # a third are one vector: ties
    return out


def awkward():
    rows = vectors(1, 90, 5, 0.3)
    rows += [(500, None, 1), (501, [1.0, None, 0.0, 0.0, 0.0], 1), (502, [float("nan")] * 5, 1), (503, [float("inf")] + [0.0] * 4, 0),
             (504, [1.0] * 5, None), (None, [1.0] * 5, 1), (505, [], 1), (506, [1.0, 2.0], 2), (510, [-1.0] * 5, 0),
             (7, [0.5] * 5, 1), (7, [0.5] * 5, 1), (30, [0.1] * 5, 2)]
    return rows


def brute(rows, is_anchor):
    held = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((k, i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for k, i, label, q in held:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, r, other) for r, j, other, v in held if r != k)
        for p, j, _, _ in [s for s in scored if s[3] == label][:5]:
            found = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, n + 1, s[1], -p, -s[0]) for n, s in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, leaf, anchors", [(8192, 128, 256), (40, 4, 3), (7, 2, 1)])
def test_against_all_scores(spark, block, leaf, anchors, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "LEAF", leaf)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rows = awkward()
    given = spark.createDataFrame([(*r, "x", "y", "z", "a", "b") for r in rows], SCHEMA).coalesce(1)
    got = hn.hard_negatives(hn.prepare(stage(given, "test-vectors")), F.col("id") % 10 == 0).collect()
    # Ties between rows of one id go by stored row, which the columns do not show.
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0)


def test_repeated_blocks_are_not_broadcast(spark, monkeypatch):
    """Every anchor meets every tree once, and the blocks, repeated for every tree, stay out of the driver."""
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    given = spark.createDataFrame(vectors(3, 90, 5, 0.3), "vec_id long, embedding array<float>, label int")
    rows = stage(hn.prepare(given), "test-rows")
    trees, anchors = hn.build_trees(rows), rows.where("id % 10 = 0")
    met = hn._meet(trees, anchors).select("tree", F.explode("anchors").alias("a")).select("tree", "a.row")
    got = Counter(tuple(r) for r in met.collect())
    assert got == Counter((t.tree, a.row) for t in trees.collect() for a in anchors.collect()) and len(got) > 100
    assert not re.search("Broadcast|Cartesian", met._jdf.queryExecution().executedPlan().toString())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(hn.prepare(none), F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0], 1, *["x"] * 5)], SCHEMA)
    assert hn.hard_negatives(hn.prepare(alone), F.col("id") % 10 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(k, [float((k * 7919) % 250_000), float(-(k * 104_729) % 250_000), 1.0], k % 2) for k in range(60)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hn.hard_negatives(hn.prepare(given), F.col("id") % 10 == 0).collect()
    want = brute([(i, [float(x) for x in v], label) for i, v, label in rows], lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == want and want


@pytest.mark.parametrize("n, width", [(1, 3), (2000, 3), (3000, 12), (500, 40), (300, 1)])
def test_boxes_hold_their_rows(n, width):
    v = np.random.default_rng(n).integers(-300, 300, (n, width)).astype(np.int32)
    order, ends, lows, highs = hn.str_pack(v)
    assert sorted(order.tolist()) == list(range(n))
    starts = [0, *ends[:-1]]
    assert all(0 < b - a <= hn.LEAF for a, b in zip(starts, ends)) and ends[-1] == n
    sizes = hn.levels(len(ends))
    assert len(lows) == sum(sizes)
    for k, (a, b) in enumerate(zip(starts, ends)):
        assert (v[order[a:b]].min(axis=0) == lows[k]).all() and (v[order[a:b]].max(axis=0) == highs[k]).all()
    assert (lows[-1] == v.min(axis=0)).all() and (highs[-1] == v.max(axis=0)).all()


def test_boxes_are_skipped():
    """Where rows lie in clusters, the queue ends long before all leaves are read."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 500, (60, 3))
    v = (centers[rng.integers(0, 60, 6000)] + rng.normal(0, 3, (6000, 3))).astype(np.int32)
    order, ends, lows, highs = hn.str_pack(v)
    as_bytes = lambda x, kind="<i8": np.asarray(x).astype(kind).tobytes()
    row = {"width": 3, "rows": as_bytes(order), "ids": as_bytes(order), "labels": as_bytes(np.zeros(6000)),
           "ends": as_bytes(ends), "lows": as_bytes(lows, "<i4"), "highs": as_bytes(highs, "<i4"),
           "vectors": as_bytes(v[order], "<i4")}
    tree = hn.RTree(row, v[:20])
    read = []
    walk = tree.walk
    tree.walk = lambda *a: (read.append(x) or x for x in walk(*a))
    for k in range(20):
        scores = sorted((-(v[r].astype(int) @ v[k].astype(int)), r) for r in range(6000) if r != k)
        assert [(s, i) for s, i, _ in tree.positives(k, k, 0, 5)] == [(s, r) for s, r in scores[:5]]
    assert len(read) < 20 * len(ends) / 3


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, d):
    name = "op12_hard_negatives"
    got = QUERIES[name](spark, d)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = c.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
