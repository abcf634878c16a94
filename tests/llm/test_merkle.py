"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from arrears.llm import merkle
from arrears.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string, key string, hash string"


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in row])


def plain_tree(leaves):
    """Last node and the siblings (before, after) of every leaf."""
    proofs, level, reach = [[] for _ in leaves], list(leaves), 1
    while len(level) > 1:
        for k in range(len(leaves)):
            at = k // reach
            run = level[at // 3 * 3:at // 3 * 3 + 3]
            proofs[k].append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        level = [h(*level[k:k + 3]) for k in range(0, len(level), 3)]
        reach *= 3
    return level[0], proofs


def brute(rows, change):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    placed, subroots = {}, []
    for s in names:
        order = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, proofs = plain_tree([leaf(r) for r in order])
        placed[s] = order, proofs
        subroots.append(top)
    root, upper = plain_tree(subroots)
    out = Counter()
    for s, subroot, rest in zip(names, subroots, upper):
        for r, own in zip(*placed[s]):
            steps = own + rest
            folded = leaf((*r[:4], change(r)))
            for before, after in steps:
                folded = h(before, folded, after)
            out[r[0], leaf(r), subroot, root, h(*[a + b for a, b in steps]), folded] += 1
    return out


def tampered(row):
    hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[4].replace("\n", "") if hit else row[4]


def corpus(sizes):
    rng = random.Random(8)
    rows = []
    for k, n in enumerate(sizes):
        source = [None, "", "é", "a", "b", "zz"][k % 6] if k < 6 else f"s{k}"
        for _ in range(n):
            rows.append((rng.choice([None, *range(n * 2 + 1)]) if rng.random() < 0.2 else rng.randrange(10 ** 6), source,
                         rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "x\ny\n", "long " * 500, "中\n文"])))
    return rows + rows[:4]


@pytest.mark.parametrize("sizes", [[1], [3], [4], [82, 1], [1, 2, 3, 4, 10, 28], [7, 81, 243, 250, 1, 90, 2, 2, 2, 2]])
def test_against_a_plain_tree(spark, sizes):
    rows = corpus(sizes)
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA).repartition(4)
    change = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(
        F.col("text"))
    got = merkle.manifest(docs, change).withColumn(
        "proof", F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256))
    assert Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect())) == brute(
        rows, tampered)


def test_only_every_fourth_level_is_stored(spark):
    leaves = spark.range(7000).select(F.lit("t").alias("tree"), F.col("id").alias("place"), F.lit(7000).cast("long").alias("leaves"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    levels = merkle.build(leaves)
    assert [x.count() for x in levels] == [7000, 87, 2, 1]
    top, proofs = plain_tree([h(str(k)) for k in range(7000)])
    assert merkle.tops(levels).collect() == [("t", top)]
    got = {r["place"]: [tuple(s) for s in r["steps"]] for r in merkle.proofs(levels).collect()}
    assert got == dict(enumerate(proofs))


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_untouched_text_verifies(spark):
    docs = spark.createDataFrame([(k, "s", "en", 1, f"text {k}") for k in range(30)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).where("folded_root = root").count() == 30


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, d):
    name = "op13_merkle_manifest"
    got = QUERIES[name](spark, d)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = c.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(map(tuple, got.select(*want.columns).collect()))
    assert rows == Counter(want.fetchall())
    assert 0 < sum(n for r, n in rows.items() if r[want.columns.index("verified")]) < sum(rows.values())
