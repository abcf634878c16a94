"""The registered functions, whole, against plain Python over the smallest tables."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from arrears.llm import license_scan, toxicity
from arrears.llm.queries import N_SHARDS, QUERIES
from tests.llm.test_llm_operators import WORD, brute_components, brute_print, lm_brute, low

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select(
        "doc_id", "text", "source", "lang").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet").collect()


@pytest.fixture(scope="module")
def word_ids(corpus):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in corpus}


def rows_of(spark, name):
    return QUERIES[name](spark, D).collect()


def test_op2_token_files(spark, corpus, word_ids):
    got, at = {r["doc_id"]: r for r in rows_of(spark, "op2_token_files")}, 0
    assert len(got) == len(corpus)
    for i, *_ in corpus:
        ids = [*word_ids[i], 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_op3_license_scan(spark, corpus):
    got = {r["doc_id"]: r for r in rows_of(spark, "op3_license_scan")}
    for i, text, *_ in corpus:
        w, r = WORD.findall(low(text)), got[i]
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w))
                  if w[k:k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not places
        assert 0 <= r["score"] <= 1


def test_op4_toxicity(spark, corpus, labels):
    """Scores follow from the model's weights; labelled documents are told apart."""
    docs, table = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_toxicity")}
    for i, text, *_ in corpus:
        held = WORD.findall(low(text))
        marks = set(held) | {f"{w[:k]}*" for w in held for k in (4, 5, 6) if len(w) >= k}
        z = sum(v for w, v in model.weights.items() if w in marks)
        p = [1 / (1 + np.exp(min(t - z, 700))) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(p), abs=1e-9) and got[i]["rejected"] == (p[0] >= 0.5)
    known = [(r["toxic"], got[r["doc_id"]]["rejected"]) for r in labels if r["doc_id"] in got and r["toxic"] is not None]
    assert np.mean([bool(a) == b for a, b in known]) > 0.95


def test_op5_token_rollup(spark, corpus, word_ids):
    """The four batches, added up by hand."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    second = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first_of = {}
    for i, text, *_ in corpus:  # by ascending id
        first_of.setdefault(text or "", i)
    want = defaultdict(lambda: [0, 0])
    for i, text, source, lang in corpus:
        if first_of[text or ""] != i:
            continue
        for name, n in (("word_bpe_49k", len(word_ids[i]) + 1), ("byte_bpe_50k", len(second.encode_ordinary(text or "")))):
            want[source, lang, name][0] += 1
            want[source, lang, name][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["docs"], r["tokens"]] for r in rows_of(spark, "op5_token_rollup")}
    assert got == dict(want)


def test_op7_lm_scores(spark, corpus, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    got = {r["doc_id"]: r for r in rows_of(spark, "op7_lm_scores")}
    for i, n, target, background in lm_brute(corpus, good):
        assert got[i]["n_tokens"] == n
        if target is not None:
            assert got[i]["loss_target"] == pytest.approx(target, rel=1e-9)
            assert got[i]["loss_background"] == pytest.approx(background, rel=1e-9)


def test_op8_simhash(spark, corpus):
    prints = {i: brute_print(text) for i, text, *_ in corpus}
    part, least = brute_components(prints.values()), {}
    for i, p in prints.items():
        least[part[p]] = min(i, least.get(part[p], i))
    assert Counter(map(tuple, rows_of(spark, "op8_simhash"))) == Counter(
        (i, f"{p:016x}", least[part[p]]) for i, p in prints.items())


def test_op10_shard(spark, corpus):
    got, slots = rows_of(spark, "op10_shard"), defaultdict(list)
    texts = {r[0]: (r[1] or "").encode() for r in corpus}
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(N_SHARDS)) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(N_SHARDS)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_digests_are_of_the_listed_items(spark):
    got = rows_of(spark, "op1_decontaminate")
    none = hashlib.sha256(b"").hexdigest()
    assert all((r["n_items"] == 0) == (r["items_sha256"] == none) and (r["n_near"] == 0) == (r["near_sha256"] == none) for r in got)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got) and any(r["contaminated"] for r in got)
