"""Best-fit decreasing packing against a plain loop, and whole texts against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from arrears.llm import tokens
from arrears.llm.packing import OpenBins, best_fit_plan, pack, piece_digests
from arrears.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, length string, ids string, sequence_id string"


def plain_best_fit(lengths, capacity):
    """Rooms left in the bins of best-fit decreasing."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return Counter(rooms)


def laid_out(counts, capacity):
    """Pieces of every bin of a plan: (offset, length)."""
    bins = defaultdict(list)
    given = Counter()
    for length, first, last, number, offset in best_fit_plan(counts, capacity):
        assert first == given[length] and last > first
        given[length] = last
        for k in range(last - first):
            bins[number + k].append((offset, length))
    assert given == Counter(counts)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    bins = laid_out(dict(Counter(lengths)), capacity)
    rooms = Counter()
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        rooms[capacity - at] += 1
    assert rooms == plain_best_fit(lengths, capacity)
    assert sorted(bins) == list(range(len(bins)))


def test_plan_size_does_not_grow_with_the_pieces():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 1000) for n in range(1, 2049)}
    small = len(best_fit_plan(counts))
    large = len(best_fit_plan({n: c * 1_000_000 for n, c in counts.items()}))
    assert large < 2 * small + 2048 and large < 100_000


def test_tightest_open_bin():
    rng = random.Random(9)
    tree, held = OpenBins(100), defaultdict(list)
    for k in range(3000):
        least = rng.randint(1, 100)
        want = min((r for r, x in held.items() if x and r >= least), default=None)
        assert tree.tightest(least) == want
        if want is not None and rng.random() < 0.6:
            assert tree.take(want) == held[want].pop()
        else:
            tree.add(least, k, 1)
            held[least].append((k, 1))


def texts():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "it's", "délta", "eps,", "中文", "x1", "\n\n", "  ", "\t", "\xa0", "don't", "<|endoftext|>"]
    out = [None, "", " ", "a", "A  b\n\n c \n", " ".join(rng.choice(vocab) for _ in range(9000))]
    return out + [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(60)]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, capacity):
    rows = [(k if k % 9 else None, t, "x", "y", "z", "w") for k, t in enumerate(texts())]
    rows += rows[:5] * 3  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = pack(docs, BYTES, end_id=0, capacity=capacity)
    library = Tokenizer.from_file(BYTES)
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    sequences = packed.collect()
    lengths, got = [], Counter()
    for s in sequences:
        held, at = np.frombuffer(s["ids"], f"<u{s['width']}").tolist(), 0
        assert len(held) == s["n_tokens"] <= capacity
        for p in s["pieces"]:
            assert p["offset"] == at
            at += p["length"]
            lengths.append(p["length"])
            got[p["doc_id"], p["piece"], p["start"], tuple(held[p["offset"]:at])] += 1
        assert at == len(held)
    want = Counter()
    for r, x in zip(rows, ids):
        cut = [0, *range(len(x) % capacity or capacity, len(x), capacity), len(x)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[r[0], k, a, tuple(x[a:b])] += 1
    assert got == want
    assert Counter(capacity - s["n_tokens"] for s in sequences) == plain_best_fit(lengths, capacity)
    assert len({s["sequence_id"] for s in sequences}) == len(sequences)


def test_empty_table(spark):
    assert piece_digests(pack(spark.createDataFrame([], SCHEMA), BYTES, end_id=0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["op11_best_fit_packing"](spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    library = Tokenizer.from_file(BYTES)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert piece == k and start == at and (k == 0 or length == 2048)
            at += length
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(2048 - sum(n for _, n in p) for p in by_sequence.values()) == plain_best_fit(
        [r["length"] for r in got], 2048)


ALPHABET = list("aAbZ09's.,!?éßİ中🙂٣½ \n\t\r\x0b\x0c\x1c\x85\xa0 　᠎") + ["  ", " \n", "'re", "<|endoftext|>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_spaced_texts_equal_the_library(text):
    encoder = tokens.text_encoder(tokens.definition(BYTES))
    assert isinstance(encoder, tokens.SpacedEncoder)
    got = np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "SPACED_PARTS", 30)
    encoder = tokens.SpacedEncoder(tokens.definition(BYTES))
    library = Tokenizer.from_file(BYTES)
    for t in texts():
        got = encoder.encode([t.encode() if t else None])[0]
        assert np.frombuffer(got, encoder.dtype).tolist() == library.encode(t or "", add_special_tokens=False).ids


def small_tokenizer(before, normalizer=None):
    letters = "abcdehlorw"
    vocab = {c: k for k, c in enumerate([*letters, "Ġ", "Ċ", "▁", "he", "ll", "Ġw", "or", "Ġh"])}
    t = Tokenizer(models.BPE(vocab, [("h", "e"), ("l", "l"), ("Ġ", "w"), ("o", "r"), ("Ġ", "h")]))
    t.pre_tokenizer, _ = before, None
    if normalizer:
        t.normalizer = normalizer
    return t


@pytest.mark.parametrize("t, kind", [
    (small_tokenizer(pre_tokenizers.ByteLevel(add_prefix_space=False)), tokens.SpacedEncoder),
    (small_tokenizer(pre_tokenizers.ByteLevel(add_prefix_space=True)), tokens.WholeEncoder),
    (small_tokenizer(pre_tokenizers.Metaspace()), tokens.WholeEncoder),
    (small_tokenizer(pre_tokenizers.WhitespaceSplit()), tokens.PieceEncoder),
    (small_tokenizer(pre_tokenizers.WhitespaceSplit(), normalizers.Prepend("▁")), tokens.WholeEncoder),
])
def test_the_way_follows_the_definition(t, kind):
    encoder = tokens.text_encoder(t.to_str())
    assert type(encoder) is kind
    for text in ("hello world", "hello  world\n hello", " he ", "", "\nhello\n\nworld"):
        got = np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist()
        assert got == t.encode(text, add_special_tokens=False).ids
