"""The pipeline against brute force, stage by stage, and on awkward tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES, drop_benchmark, near_dedup, run

from arrears.llm import simhash, toxicity
from arrears.llm.common import stage
from tests.llm.test_llm_operators import SCHEMA, awkward, brute_components, brute_hits, brute_near, brute_print

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, f in STAGES:
        result = f(spark, docs, SMALL).cache()
        out[name] = docs.collect(), result.collect()
        docs = result
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.createDataFrame(before)
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.probabilities(r["text"])[0] < 0.5}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    prints = {r["doc_id"]: brute_print(r["text"]) for r in before}
    part = brute_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[part[p]] = min(i, least.get(part[p], i))
    assert {r["doc_id"] for r in after} == set(least.values())


def test_benchmark_passages_go(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    short = [(i, t) for i, t in items if t]
    want = {r["doc_id"] for r in before if not brute_hits(r["text"], short, 10)[1] and not brute_near(r["text"], short, 10)}
    assert {r["doc_id"] for r in after if r["doc_id"] in want} == want
    assert all(r["doc_id"] in want for r in after)


def test_mix_and_shards(stages):
    before, mixed = stages["mix"]
    uses = Counter(r["doc_id"] for r in mixed)
    assert set(uses) <= {r["doc_id"] for r in before} and max(uses.values()) <= 3
    _, dealt = stages["shard"]
    assert Counter(r["doc_id"] for r in dealt) == uses
    slots = defaultdict(list)
    for r in dealt:
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(40)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert Counter(map(key, run(spark, SMALL).collect())) == Counter(map(key, stages["shard"][1]))


@pytest.mark.parametrize("rows", [awkward(), []])
def test_stages_take_awkward_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = docs.columns
    for name, f in STAGES:
        out = f(spark, docs, SMALL).cache()
        assert out.columns == columns or name == "shard"
        if name in ("toxicity", "decontamination"):
            assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()
        if name == "near_dedup":  # one row of every component stays, with or without id
            groups = simhash.simhash_groups(docs).select("fingerprint").distinct().count()
            assert out.count() <= groups or not rows
        docs = out
    assert docs.count() > 0 or not rows


def text_of(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def with_ids(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_goes_by_row(spark):
    a, b, c = text_of(1), text_of(2), text_of(3)
    # Repeats of the kept id go; id 4 holds two texts, of which one is a copy of 3 and the other the least of its group.
    docs = with_ids(spark, [(1, a), (1, a), (1, a), (2, a), (3, b), (4, b), (4, c), (5, c), (None, a)])
    got = Counter((r["doc_id"], r["text"]) for r in near_dedup(spark, docs, SMALL).collect())
    assert got == Counter([(1, a), (3, b), (4, c)])


def test_near_copies_without_id(spark):
    a, b = text_of(1), text_of(2)
    docs = with_ids(spark, [(None, a), (None, a), (None, f"{a} "), (None, b), (7, b)])
    got = Counter((r["doc_id"], r["text"].strip()) for r in near_dedup(spark, docs, SMALL).collect())
    assert got == Counter([(None, a), (7, b)])


def test_columns_with_names_of_the_operators(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    passage = max((t for t in items if t), key=len)
    rows = [(1, text_of(1)), (2, text_of(1)), (None, text_of(2)), (4, passage), (5, text_of(3))]
    names = ["_row", "_file", "_place", "_base", "_path", "_metadata", "row", "rank", "epochs", "_p", "_h"]
    docs = with_ids(spark, rows).select("*", *[F.concat(F.lit(f"{n} "), "text").alias(n) for n in names])
    for name, f in STAGES:
        out = stage(f(spark, docs, SMALL), "test-names")
        assert out.columns[:len(docs.columns)] == docs.columns
        assert all(r[n] == f"{n} {r['text']}" for r in out.collect() for n in names)
        docs = out
    assert {r["doc_id"] for r in docs.collect()} <= {1, None, 5}


def test_benchmark_passages_go_by_row(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    passage = max((t for t in items if t), key=len)
    clean = text_of(4)
    docs = with_ids(spark, [(None, clean), (None, passage), (1, clean), (1, f"{clean} {passage}"), (2, passage)])
    got = Counter((r["doc_id"], r["text"]) for r in drop_benchmark(spark, docs, SMALL).collect())
    assert got == Counter([(None, clean), (1, clean)])


def test_near_passages_go(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    passage = max((t for t in items if t), key=len).split()
    lightly = " ".join(w for k in range(0, len(passage), 6) for w in (*passage[k:k + 6], "qqqq"))
    turned = " ".join(w for k in range(0, len(passage), 2) for w in passage[k:k + 2][::-1])
    far = " ".join(f"{w} qqqq qqqq" for w in passage)
    docs = with_ids(spark, [(1, f"{text_of(5)} {lightly}"), (2, turned), (3, far), (4, text_of(6))])
    assert {r["doc_id"] for r in drop_benchmark(spark, docs, SMALL).collect()} == {3, 4}


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
