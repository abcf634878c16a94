"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from arrears.llm import curriculum, decontaminate, exact_dedup, hypergeometric, license_scan, lm_score
from arrears.llm import shard as sharding
from arrears.llm import simhash, token_file, token_rollup, tokens, toxicity
from arrears.llm.common import fresh_path, stage, words
from arrears.llm.queries import ORACLE_SQL, QUERIES, repeating_weights

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, _p int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    """Nulls, empties, ties, repeated rows, very long texts, and columns named like results."""
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gamma,", "délta", "eps", "Zeta.", "中文", "x1", "the", "THE", "of", "and"]
    long_text = " ".join(rng.choice(vocab) for _ in range(60_000))
    base = " ".join(rng.choice(vocab) for _ in range(80))
    rows = [(1, base), (2, base), (2, base), (3, base.replace(" ", "\n\t")), (4, base + " tail"), (5, None), (6, ""),
            (7, " \n\t "), (None, base), (None, None), (8, long_text), (9, long_text), (10, "a"), (11, "A"),
            (12, "Licensed under the MIT License."), (13, "the MIT Licence; Apache-License; cc by cc by"),
            (14, "GNU Genral Public License and GNU General Public License"), (15, "<|endoftext|> it's İstanbul")]
    rows += [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for k in range(20, 60)]
    sources = ["a", "b", None, "ç", "a", "a"]
    return [(i, t, "en", sources[k % 6], None, "x", "y", 7) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return awkward()


# ---- exact dedup

def test_exact_dedup(docs, rows, nothing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    want = Counter()
    for key, held in groups.items():  # one row of a group stays, also of rows that repeat
        for k, (_, _, _, i) in enumerate(sorted(held, key=lambda x: x[:3])):
            want[(i, min(held)[3], len(held), k == 0, hashlib.sha256(key.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "x"), (None, "x"), (None, None), (None, "")] + [(5, "hot")] * 50
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(got) == len(rows) and set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


# ---- sharding

def test_hypergeometric_matches_the_law():
    rng = random.Random(1)
    draws = [hypergeometric.draw(rng, 30, 50, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 7.5) < 0.05
    assert abs(np.var(draws) - 20 * .375 * .625 * 60 / 79) < 0.12
    assert hypergeometric.draw(rng, 0, 5, 3) == 0 and hypergeometric.draw(rng, 5, 0, 3) == 3
    big = hypergeometric.draw(rng, 10**10, 39 * 10**10, 10**8)
    assert abs(big - 10**8 / 40) < 6 * (10**8 / 40) ** 0.5


def test_matrix_margins():
    m = hypergeometric.matrix([5, 0, 17, 3], [10, 0, 15], seed=3)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m)] == [10, 0, 15]


@pytest.mark.parametrize("n", [1, 7, 200])
def test_shard_sizes_slots_and_reruns(docs, rows, n):
    got = sharding.shard(docs, n, partitions=9).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard(docs.repartition(2), n, partitions=9).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_shards_do_not_depend_on_the_shuffle_setting(spark):
    docs = spark.range(9000).withColumnRenamed("id", "doc_id")
    kept, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, sharding.shard(docs, 7).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got[0] == got[1]


def test_shard_is_a_uniform_shuffle(spark, nothing):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    hits = Counter()
    for seed in range(5):
        hits.update(r["shard"] for r in sharding.shard(ids, 4, seed=seed).where("doc_id < 400").collect())
    assert all(abs(hits[s] - 500) < 110 for s in range(4))
    assert sharding.shard(nothing, 3).count() == 0


def test_shard_spreads_repeats(spark):
    """Uses of a document, and a row that is a third of all, go where chance sends them."""
    rows = [(k, f"t{k}") for k in range(800) for _ in range(3)] + [(None, "hot")] * 1200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard(docs, 4, partitions=9).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    uses, slots = defaultdict(list), defaultdict(list)
    for r in got:
        uses[r["doc_id"]].append((r["shard"], r["slot"]))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(900)) for v in slots.values())
    hot = uses.pop(None)
    assert all(abs(sum(s == k for s, _ in hot) - 300) < 75 for k in range(4))
    assert sum((s, t + 1) in set(hot) for s, t in hot) < 600  # by chance a third, 400
    assert 20 < sum(len({s for s, _ in v}) == 1 for v in uses.values()) < 90  # by chance a sixteenth, 50
    assert sum((s, t + 1) in v for v in uses.values() for s, t in v) < 20


# ---- mixing

def fill(sizes, weights, cap):
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[k] for k in full)
        w = sum(x for k, x in enumerate(weights) if k not in full)
        out = [cap * s if k in full else rest * weights[k] / w for k, s in enumerate(sizes)]
        over = {k for k, s in enumerate(sizes) if k not in full and out[k] > cap * s}
        if not over:
            return out
        full |= over


def test_mix_targets(docs, rows, nothing):
    size = lambda t: len(PLAIN.findall(t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    targets = dict(zip(names, fill(sizes, [1 + k % 3 for k in range(len(names))], 3)))
    got = curriculum.assign(docs, repeating_weights).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows)
    for k, s in enumerate(names):
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(targets[s]) and r["source_size"] == sizes[k] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 3 * r["size"] and r["epochs"] <= 3 for r in got)
    assert all((r["position"] is None) == (r["epochs"] == 0) for r in got)
    assert curriculum.assign(nothing, repeating_weights).count() == 0


def test_mix_order_and_repeats(spark):
    rows = [(k, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ramp = lambda rank: (F.when(rank == 0, 2.0).otherwise(0.0), F.when(rank == 0, 0.0).otherwise(2.0))
    out = curriculum.mix(docs, ramp).collect()
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    half = len(out) // 2
    first = sum(r["source"] == "a" for r in out[:half]) / half
    last = sum(r["source"] == "a" for r in out[half:]) / (len(out) - half)
    assert 0.68 < first < 0.82 and 0.18 < last < 0.32  # integral of the ramp: 3/4 and 1/4
    placed = {r["doc_id"]: r["epochs"] for r in curriculum.assign(docs, ramp).collect()}
    assert Counter(r["doc_id"] for r in out) == Counter({k: v for k, v in placed.items() if v})


def test_mix_takes_every_row_by_its_own_epochs(spark):
    rows = [(None if k % 3 == 0 else -7 if k % 3 == 1 else k, f"t{k} " + "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = curriculum.mix(docs, repeating_weights).collect()
    uses = Counter(r["text"] for r in out)
    assert max(uses.values()) <= 3 and set(uses) <= {r[1] for r in rows}
    assert len({(r["text"], r["epoch"]) for r in out}) == len(out)
    placed = curriculum.assign(docs, repeating_weights).collect()
    assert len(out) == sum(r["epochs"] for r in placed)
    target = {r["source"]: r["target"] for r in placed}
    for s, want in target.items():
        assert abs(sum(len(PLAIN.findall(r["text"])) for r in out if r["source"] == s) - want) <= 9


def test_mix_places_a_hot_id_in_parts(spark):
    rows = [(None, "w " * (k % 3), "a") for k in range(900)] + [(k, "w " * 5, "ab"[k % 2]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = curriculum.assign(docs, repeating_weights)
    for s in "ab":  # places follow one another without gaps or overlaps
        at = 0
        for r in got.where(F.col("source") == s).orderBy("offset", F.col("size") > 0).collect():
            assert r["offset"] == at or r["size"] == 0
            at = max(at, r["offset"] + r["size"])
        assert at == r["source_size"]
    assert got.count() == len(rows)


# ---- licences

def test_license_scan(docs, rows, nothing):
    got = license_scan.license_scan(docs, out_col="kept").collect()
    assert len(got) == len(rows)
    for r in got:
        w, s = WORD.findall(low(r["text"])), r["kept"]
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w))
                  if w[k:k + len(phrase.split())] == phrase.split()]
        assert (s["n_words"], s["n_base"]) == (len(w), len(places))
        assert s["first_word"] == (min(places)[0] if places else None)
        assert s["last_word"] == (max(places)[0] if places else None)
        assert s["base_labels"] == sorted({x for _, x in places}) and set(s["base_labels"]) <= set(s["labels"])
        assert 0 <= s["score"] <= 1 and (s["score"] == 1) >= bool(places)
    by_id = {r["doc_id"]: r["kept"] for r in got}
    assert by_id[14]["labels"] == ["gpl"] and [x["edits"] for x in by_id[14]["spans"]] == [1, 0]
    assert "mit" in by_id[13]["labels"] and by_id[13]["n_base"] == 3
    assert license_scan.license_scan(nothing).count() == 0


def test_seeds_lose_no_fuzzy_match():
    rng = random.Random(2)
    phrase = "gnu general public license"
    k = license_scan.edits_allowed(phrase)
    whole = regex.compile(rf"(?b)(?<![^ ])(?:{phrase}){{e<={k}}}(?![^ ])")
    for _ in range(400):
        text = list(phrase)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            text[at:at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
        line = f"some words {''.join(text)} more words"
        found = whole.search(line)
        want = bool(found) and "gnu" in found[0].split()  # short words take no edit
        assert bool(license_scan.fuzzy_spans(line.encode(), phrase)) == want, line


@pytest.mark.parametrize("text, label", [
    ("under the MIT license", True), ("under the MIT licence", True), ("the MIT-Licens here", True),
    ("an IT license", False), ("a kit license", False), ("a bit license", False), ("mits license", False)])
def test_short_words_take_no_edit(text, label):
    found = license_scan.scan_text(text)
    assert (found["labels"] == ["mit"]) == label and (label or found["score"] == 0)


# ---- decontamination

def brute_hits(text, items, size):
    w, hit, held, places = WORD.findall(low(text)), set(), set(), defaultdict(list)
    for k, x in enumerate(w):
        places[x].append(k)
    for item, t in items:
        v = WORD.findall(low(t))
        for k in range(max(1, len(v) - size + 1) if v else 0):
            win = v[k:k + size]
            for at in places.get(win[0], ()):
                if w[at:at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    held.add(item)
    return len(w), len(hit), held


def brute_near(text, items, size, slop=5):
    """Items with a whole window whose words stand, as often, in a slice of the text."""
    w, held = WORD.findall(low(text)), set()
    for item, t in items:
        v = WORD.findall(low(t))
        for win in {tuple(v[k:k + size]) for k in range(len(v) - size + 1)}:
            need = Counter(win)
            if set(need) <= set(w) and any(w[k] in need and not need - Counter(w[k:k + size + slop]) for k in range(len(w))):
                held.add(item)
                break
    return held


@pytest.mark.parametrize("passes", [1, 3])
def test_decontaminate(spark, docs, rows, nothing, passes, monkeypatch):
    bench = [(1, rows[0][1][:120]), (2, "tail"), (3, None), (4, " ,, "), (1, rows[0][1][60:200]), (10, "a"),
             (20, "mit license"), (30, "nowhere to be found"), (None, "x1")]
    bench.append((40, " ".join(rows[0][1].split()[40:10:-1])))
    if passes > 1:
        monkeypatch.setattr(decontaminate, "PASS_BYTES", 150)
    items = spark.createDataFrame([(*b, "z") for b in bench], "item_id long, text string, doc_id string")
    index = stage(decontaminate.build_index(docs, block_words=3000), "test-index")
    got = decontaminate.digest(decontaminate.search(index, items, proximity=True)).collect()
    want, known = Counter(), {}
    given = [b for b in bench if b[1]]
    listed = lambda ids: ",".join(sorted(map(str, ids - {None})))
    for i, t, *_ in rows:
        if t not in known:
            known[t] = *brute_hits(t, given, 10), brute_near(t, given, 10)
        n, hit, held, near = known[t]
        sums = [x for s in (held, near) for x in (len(s - {None}), hashlib.sha256(listed(s).encode()).hexdigest())]
        want[(i, n, hit, *sums[:2], hit > 0, *sums[2:])] += 1
    assert Counter(map(tuple, got)) == want
    assert len(got) == len(rows)
    assert decontaminate.digest(decontaminate.decontaminate(nothing, items)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.digest(
        decontaminate.search(index, items.where("false"))).collect())


def near_spans(spark, docs, items, window):
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, items, window=window, proximity=True).collect()
    return {r["doc_id"]: [(m["start"], m["end"], m["kind"]) for m in r["matches"]] for r in found}


def test_proximity(spark):
    docs = [(1, "red big apple tree"), (2, "apple x y red z tree big"), (3, "red apple " + "x " * 20 + "big tree"), (4, "red apple")]
    assert near_spans(spark, docs, [(9, "red apple big tree")], 4) == {
        1: [(0, 4, "near")], 2: [(0, 7, "near")], 3: [], 4: []}


def test_proximity_at_a_document_border(spark):
    docs = [(1, "lemon x the"), (2, "big red the apple tree"), (3, "tree")]
    assert near_spans(spark, docs, [(9, "the red big apple tree")], 5) == {1: [], 2: [(0, 5, "near")], 3: []}


def test_proximity_counts_repeated_words(spark):
    docs = [(1, "the end"), (2, "to be or"), (3, "by someone cc"), (4, "or be be be be to to x to to to"), (5, "the " * 9),
            (6, "the x " * 5 + "the the the the the")]
    assert near_spans(spark, docs, [(1, "the " * 10), (2, "to to to to to be be be be or"), (3, "cc by")], 10) == {
        1: [], 2: [], 3: [], 4: [(0, 11, "near")], 5: [], 6: [(0, 15, "near")]}


def test_proximity_finds_what_a_scan_finds():
    rng = random.Random(6)
    for _ in range(300):
        names = [rng.choice("abcd").encode() for _ in range(rng.randint(1, 30))]
        window = [rng.choice("abcd").encode() for _ in range(5)]
        row = decontaminate._block_row("b", [0], [names])
        found, _ = decontaminate.search_block(row, {tuple(window): [1]}, 5, True, 3)
        need = Counter(window)
        want = any(not need - Counter(names[k:k + 8]) for k in range(len(names)))
        assert bool(found.get((0, 1, "near"))) == want


# ---- SimHash

def brute_print(text):
    w = PLAIN.findall(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest()
         for s in ([w] if len(w) < 3 else [w[k:k + 3] for k in range(len(w) - 2)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def test_simhash(docs, rows, nothing):
    got = simhash.simhash_groups(docs).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    part = brute_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", least.get(part[p])) for i, p in prints)
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_links_find_every_component(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {0, 1, 2**64 - 1, 2**63}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains: each step within the radius of the one before
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df)).collect()}
    part = brute_components(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[got.get(p, p)].add(p)
    want = defaultdict(set)
    for p, r in part.items():
        want[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, 1001: 1000}


# ---- token files and counts

def library_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.PieceEncoder(tokens.definition(path))
    rng = random.Random(1)
    letters = list("aAbZ09'sStréÉßİıŒœǅΣσς̧ \t\n\x0b\x1c\x85\xa0.,!?-_<|>中한ﬁ½²ªºµ\x00\x7f٣Ⅷ🙂") + ["<|endoftext|>", "'re", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == library_ids(path, texts)


def test_pieces_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.PieceEncoder(tokens.definition(public_tokenizers.path("word_bpe_49k.json")))
    texts = [" ".join(f"word{k * j}" for j in range(40)) for k in range(50)]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == library_ids(
        public_tokenizers.path("word_bpe_49k.json"), texts)
    assert tokens.PieceEncoder(tokens.definition(path)).pattern is None


@pytest.mark.parametrize("file_tokens", [1 << 26, 500])
def test_token_files(spark, docs, rows, nothing, file_tokens, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_TOKENS", file_tokens)
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(spark, "test-tokens")
    index = token_file.write_token_files(docs, path, folder, length=16)
    got = token_file.starts(token_file.read_documents(index, folder)).orderBy("start").collect()
    ids = {(i, t): [*x, 2] for (i, t, *_), x in zip(rows, library_ids(path, [r[1] for r in rows]))}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (r[0], len(ids[r[0], r[1]]), crc(ids[r[0], r[1]])) for r in rows)
    assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in got)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    name = got[-1]["file"]
    file = token_file.TokenFile(folder, name)
    inside = sum(r["n_tokens"] for r in got if r["file"] == name)
    n = -(-inside // 16)
    pairs = [file.sequence(k) for k in range(n)]
    assert all(len(a) == 16 == len(m) for a, m in pairs) and sum(int(m.sum()) for _, m in pairs) == inside
    stream = np.concatenate([a[m] for a, m in pairs])
    assert stream.tolist() == file.tokens(0, inside).tolist()
    assert all(not x.flags.owndata for pair in pairs for x in pair)  # views of the mapped file
    assert not file.reader.get_batch(0).column(0).flatten().to_numpy(zero_copy_only=True).flags.owndata
    empty = token_file.write_token_files(nothing, path, fresh_path(spark, "test-tokens"))
    assert empty.count() == 0


def test_token_files_do_not_depend_on_the_partitioning(spark):
    """A third of the rows on one id, repeats and null ids; a tokenizer that keeps white space."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None if k % 5 == 0 else 7 if k % 3 == 0 else k, f"text  {k % 40}\n\nand more") for k in range(300)]
    docs, streams = spark.createDataFrame(rows, "doc_id long, text string"), []
    for n in (3, 8):
        folder = fresh_path(spark, "test-tokens")
        index = token_file.write_token_files(docs.repartition(n), path, folder, end_id=0, length=16)
        got = token_file.starts(token_file.read_documents(index, folder)).orderBy("start").collect()
        streams.append([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got])
    assert streams[0] == streams[1]
    ids = {t: [*x, 0] for (_, t), x in zip(rows, library_ids(path, [t for _, t in rows]))}
    assert Counter(streams[0]) == Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)


def test_rollup_is_idempotent(spark, docs, rows, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = stage(token_rollup.piece_counts(docs, path, "n_tokens").withColumn("tokenizer", F.lit("v1")), "test-counts")
    n = [len(x) for x in library_ids(path, [r[1] for r in rows])]
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "test-rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_rollup.inserts(counted)) and not rollup.commit("a", token_rollup.inserts(counted))
    want = Counter()
    for r, k in zip(rows, n):
        want[r[3], "docs"] += 1
        want[r[3], "tokens"] += k
    sums = lambda: {(r["source"], c): r[c] for r in rollup.totals().collect() for c in ("docs", "tokens")}
    assert sums() == want
    gone = counted.where("source = 'b'")
    rollup.commit("b", token_rollup.deletes(gone))
    c = counted.where("source = 'ç'")
    rollup.commit("c", token_rollup.revisions(c, c.withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("source", F.lit("d"))))
    rollup.commit("c", token_rollup.deletes(counted))
    rollup.commit("d", token_rollup.inserts(counted.where("false")))
    want = {k: v for k, v in want.items() if k[0] != "b"}
    docs_c, tokens_c = want.pop(("ç", "docs")), want.pop(("ç", "tokens"))
    want |= {("d", "docs"): docs_c, ("d", "tokens"): tokens_c + docs_c}
    assert sums() == want
    with pytest.raises(ValueError):
        rollup.commit("../x", token_rollup.inserts(nothing.withColumn("tokenizer", F.lit("v")).withColumn("n_tokens", F.lit(1))))


def test_half_written_batch_is_replaced(spark, docs):
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "test-rollup"))
    one = docs.limit(1).withColumn("tokenizer", F.lit("v")).withColumn("n_tokens", F.lit(5))
    token_rollup.inserts(one).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{rollup.folder}/batch=x")
    assert rollup.totals().count() == 0 and rollup.commit("x", token_rollup.inserts(one))
    assert [r["tokens"] for r in rollup.totals().collect()] == [5]


def test_rank_counts(docs, rows):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_rollup.rank_counts(docs, path, public_tokenizers.PATTERN, "n").select("doc_id", "n").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], len(e.encode_ordinary(r[1] or ""))) for r in rows)


# ---- toxicity

def test_ordinal_fit_orders_thresholds_and_shares_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 3)).astype(float)
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    y = (latent > 0.5).astype(int) + (latent > 2.5)
    w, theta = toxicity.fit_ordinal(x, y, np.ones(4000), 3, steps=1500)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(theta, [0.5, 2.5], atol=0.25)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    clean = ["w" + "".join(rng.choice("abcdef") for _ in range(3)) for _ in range(300)]
    bad = ["vexing", "vexed", "grim", "foul"]

    def text(n):
        w = [rng.choice(clean) for _ in range(60)] + [rng.choice(bad) for _ in range(n)]
        rng.shuffle(w)
        return " ".join(w)

    truth = [rng.choice([0, 0, 0, 2, 5]) for _ in range(1200)]
    docs = spark.createDataFrame([(k, text(n), "old") for k, n in enumerate(truth)], "doc_id long, text string, rejected string")
    labels = spark.createDataFrame([(k, int(n > 0)) for k, n in enumerate(truth[:600])], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = range(600, 1200)
    assert sum(got[k]["rejected"] == (truth[k] > 0) for k in held) >= 590
    assert np.mean([got[k]["severity"] for k in held if truth[k] == 5]) > np.mean(
        [got[k]["severity"] for k in held if truth[k] == 2]) > 0.8


def test_toxicity_edges(spark, docs, rows, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and not any(r["rejected"] or r["severity"] for r in got)
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (5, 0), (999, 1), (6, 0), (10, 2)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, toxicity.fit(docs, odd)).collect()) == len(rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, odd)).count() == 0


# ---- language-model scores

def lm_brute(rows, targets):
    """(id, words, target loss, background loss) with plain counters."""
    w = [(r[0], words(r[1])) for r in rows]
    model = [int(i in targets) for i, _ in w]
    pair, one = [Counter(), Counter()], [Counter(), Counter()]
    events = [list(zip([b"", *d], [*d, b""])) if d else [] for _, d in w]
    for m, ev in zip(model, events):
        pair[m].update(ev)
        one[m].update(x for _, x in ev)
    n = [sum(x.values()) for x in one]
    scale, size = [n[1] / n[0], 1.0], len(one[0] | one[1])
    out = []
    for (i, d), own, ev in zip(w, model, events):
        here, held, losses = Counter(ev), Counter(x for _, x in ev), []
        for m in (1, 0):
            k, s, total = int(m == own), scale[m], 0.0
            for v, x in ev:
                first = ((one[m][x] - k * held[x]) * s + 1) / ((n[m] - k * len(ev)) * s + size)
                total -= np.log(((pair[m][v, x] - k * here[v, x]) * s + lm_score.STRENGTH * first)
                                / ((one[m][v] - k * held[v]) * s + lm_score.STRENGTH))
            losses.append(total / len(ev) if ev else None)
        out.append((i, len(d), *losses))
    return out


@pytest.mark.parametrize("block", [1, 500, lm_score.BLOCK_WORDS])
def test_lm_scores_against_brute_force(spark, docs, rows, nothing, block):
    target = spark.createDataFrame([(k,) for k in (1, 2, 2, 20, 21, 22, 30)] + [(None,)], "doc_id long")
    got = lm_score.lm_scores(docs, target, block_words=block).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2] or 0, 6))
    want = sorted(lm_brute(rows, {1, 2, 20, 21, 22, 30}), key=order)
    found = sorted(((r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got), key=order)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    for a, b in zip(found, want):
        assert a[2:] == (None, None) if b[2] is None else a[2:] == pytest.approx(b[2:], rel=1e-9)
    assert all(r["score"] == pytest.approx((r["loss_target"] or 0) - (r["loss_background"] or 0)) for r in got)
    assert lm_score.lm_scores(nothing, target).count() == 0
    alone = lm_score.lm_scores(docs, target.where("false")).collect()
    assert len(alone) == len(rows) and all(r["score"] == 0 and r["loss_target"] is None for r in alone)


def test_lm_vocabulary_is_whole(spark):
    """A word that stands in two documents of a thousand decides between the models."""
    rows = [(k, f"common words here rare{k % 500}x end") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = docs.where("doc_id < 250").select("doc_id")
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, target, block_words=40).collect()}
    assert max(got[k] for k in range(500, 750)) < min(got[k] for k in range(750, 1000))
    want = {r[0]: r[2] - r[3] for r in lm_brute(rows, set(range(250)))}
    assert got == pytest.approx(want)


def test_lm_packing():
    for values in ([], [0], [-1, 2**62, 5], list(range(3000))):
        assert lm_score.unpack(lm_score.pack(np.array(values, dtype=np.int64))).tolist() == values


def test_lm_scores_tell_held_out_topics_apart(spark):
    rng = random.Random(8)
    topic = lambda k: " ".join(f"t{k}w{int(rng.paretovariate(0.7)) % 50}" if rng.random() < .3 else
                               f"w{int(rng.paretovariate(0.7)) % 50}" for _ in range(80))
    docs = spark.createDataFrame([(k, topic(k % 2)) for k in range(400)], "doc_id long, text string")
    target = docs.where("doc_id < 200 and doc_id % 2 = 0").select("doc_id")
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, target).collect()}
    near, far = [got[k] for k in range(200, 400, 2)], [got[k] for k in range(201, 400, 2)]
    assert np.mean([a < b for a in near for b in far]) > 0.95


# ---- registered queries

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    found = Counter(tuple(clean(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert found == Counter(tuple(clean(r[k]) for k in at) for r in cur.fetchall())


def test_native_plans_have_no_python(spark):
    for name in ("op9_exact_dedup", "op10_shard"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
