"""Cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary (every word of all documents and the document border), one
order, and one smoothing. Background counts are scaled to the target's number of tokens, so the
smoothing weighs alike in both. Counts come from all documents, and nothing is cut off: words
and bigrams of any rarity count, so the models grow with the corpus. Each token, the closing
border included, costs its negative log-probability under each model; a document's score is
the mean difference, target minus background: negative means closer to the target.

    P(w | v) = (c(v, w) + STRENGTH * P(w)) / (c(v) + STRENGTH),  P(w) = (c(w) + 1) / (N + V)

A document's own counts are taken out of its own model before it is scored, else every target
document would look like the target by its chance words alone.

The models are never in one place. Documents are packed into stored blocks of about
``BLOCK_WORDS`` words. A block asks for each of its distinct words and bigrams once, with its
own counts; the questions are dealt by the hash of the key, added up over all blocks, and the
sums go back to the blocks that asked. So a word that makes up a third of the corpus is one key
a block, a task holds a bounded share of the keys, and the driver only sees three totals. Words
and bigrams are told apart by 63-bit hashes.

The target ids meet the documents' ids only, not their texts; each block then gets the places
of its target documents.

Edge cases: null and word-less texts have 0 tokens, losses null and score 0. With no target
or no background words the losses are null and the scores 0. Null ids and ids without label
belong to the background. Repeated rows each count; repeated target ids count once. Empty
tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import stage, words

STRENGTH = 50.0
BLOCK_WORDS = 2_000_000
#: At most about this many keys are added up at once, and at least so many shares a shuffle partition.
SHARE_KEYS, SHARES = 2_000_000, 4
BLOCKS = "block string, n_keys bigint, doc_ids array<bigint>, ids binary, known binary, sizes binary, codes binary, hashes binary"
QUESTIONS = "share int, block string, keys binary, background binary, target binary"
ANSWERS = "share int, block string, background binary, target binary, vocabulary bigint, n_background bigint, n_target bigint"
SCORES = "id bigint, n_tokens bigint, loss_target double, loss_background double, score double"
BORDER = b""


def pack(values: np.ndarray) -> bytes:
    """Integers of 8 bytes as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").ravel()


def _block(ids: list, coded: list[np.ndarray], place: dict[bytes, int]) -> dict:
    codes = np.concatenate(coded)
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) | 1 for w in place], dtype="<u8")
    return {"block": uuid.uuid4().hex, "n_keys": len(place) + len(codes), "doc_ids": ids,
            "ids": pack(np.array([i or 0 for i in ids])), "known": pack(np.array([i is not None for i in ids])),
            "sizes": pack(sizes), "codes": pack(codes), "hashes": hashes.tobytes()}


def blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """Blocks of whole documents (see BLOCKS) from (id, text). Codes number the words of the
    block by first use; 0 is the border."""
    kinds = {"block": pa.string(), "n_keys": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in BLOCKS.split(", ")])

    def cut(batches):
        ids, coded, n, place = [], [], 0, {BORDER: 0}
        for batch in batches:
            for i, text in zip(*batch.columns):
                found = words(text.as_py())
                coded.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.int64, len(found)))
                ids.append(i.as_py())
                n += len(found) + 1
                if n >= block_words:
                    yield pa.RecordBatch.from_pylist([_block(ids, coded, place)], schema)
                    ids, coded, n, place = [], [], 0, {BORDER: 0}
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, coded, place)], schema)

    return docs.mapInArrow(cut, BLOCKS)


def with_targets(index: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The blocks plus ``target``: the places of their target documents (null: none). Rows of
    ids meet, then one row per block."""
    places = index.select("block", F.posexplode("doc_ids").alias("place", "id")).join(target_ids, "id", "left_semi")
    target = stage(places.groupBy("block").agg(F.collect_list("place").alias("target")), "lm-targets")
    return index.drop("doc_ids").join(target, "block", "left")


class Events:
    """The tokens of a block with their contexts; word-less documents have none.

    ``doc``, ``before`` and ``word`` run over events; ``pair`` is the event's place in the
    block's distinct bigrams. ``keys`` are those of the words, then of the bigrams; ``order``
    sorts them by share."""

    def __init__(self, row, shares: int):
        self.sizes = unpack(row["sizes"])
        self.target = np.zeros(self.sizes.size, dtype=np.int64)
        if row["target"] is not None:
            self.target[np.asarray(row["target"], dtype=np.int64)] = 1
        codes, hashes = unpack(row["codes"]), np.frombuffer(row["hashes"], dtype="<u8")
        self.lengths = np.where(self.sizes > 0, self.sizes + 1, 0)
        self.doc = np.repeat(np.arange(self.sizes.size), self.lengths)
        ends = np.cumsum(self.lengths)[self.sizes > 0] - 1
        inner = np.ones(self.doc.size, dtype=bool)
        inner[ends] = False
        self.word = np.zeros(self.doc.size, dtype=np.int64)
        self.word[inner] = codes
        self.before = np.concatenate([self.word[-1:], self.word[:-1]])  # after an end stands a border
        self.n_words = hashes.size
        pairs, self.pair = np.unique(self.before * self.n_words + self.word, return_inverse=True)
        mixed = (hashes[pairs // self.n_words] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs % self.n_words])
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        self.keys = np.concatenate([hashes, (mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(1)])
        self.share = ((self.keys >> np.uint64(1)) % np.uint64(shares)).astype(np.int64)
        self.order = np.lexsort((self.keys, self.share))

    def own(self, of_target: int) -> np.ndarray:
        """Counts of the keys in this block's documents of one model."""
        mine = self.target[self.doc] == of_target
        return np.concatenate([np.bincount(self.word[mine], minlength=self.n_words),
                               np.bincount(self.pair[mine], minlength=self.keys.size - self.n_words)])

    def in_document(self, code: np.ndarray) -> np.ndarray:
        """For each event, how often its document holds its code."""
        _, place, n = np.unique(self.doc * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
        return n[place]


def questions(index: DataFrame, shares: int) -> DataFrame:
    """One row per block and share: the keys in ascending order and the block's counts."""
    def ask(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                e = Events(row, shares)
                keys, counts = e.keys[e.order], [e.own(m)[e.order] for m in (0, 1)]
                share, first = np.unique(e.share[e.order], return_index=True)
                ends = [*first[1:].tolist(), keys.size]
                for at in range(0, share.size, 256):
                    cut = list(zip(first[at:at + 256].tolist(), ends[at:at + 256]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(share[at:at + 256], pa.int32()), pa.array([row["block"]] * len(cut)),
                         pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()),
                         *(pa.array([pack(c[a:b]) for a, b in cut], pa.binary()) for c in counts)],
                        names=["share", "block", "keys", "background", "target"])

    return index.select("block", "target", "sizes", "codes", "hashes").mapInArrow(ask, QUESTIONS)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over all blocks for the keys of each block; the first row carries the share's totals."""
    asked = [np.frombuffer(k, dtype="<u8") for k in group["keys"]]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    cuts = np.cumsum([k.size for k in asked])[:-1]
    out, is_word = {"share": group["share"], "block": group["block"]}, keys & np.uint64(1) == 1
    totals = {"vocabulary": int(is_word.sum())}
    for name in ("background", "target"):
        counts = np.concatenate([unpack(c) for c in group[name]])
        sums = np.zeros(keys.size, dtype=np.int64)
        np.add.at(sums, place, counts)
        out[name] = [pack(x) for x in np.split(sums[place], cuts)]
        totals[f"n_{name}"] = int(sums[is_word].sum())
    for name, n in totals.items():
        out[name] = [n] + [0] * (len(group) - 1)
    return pd.DataFrame(out)


def score_block(row, answers: pd.DataFrame, shares: int, vocabulary: int, totals: list[int]) -> pd.DataFrame:
    """Scores of a block's documents from the answers, sorted by share."""
    e = Events(row, shares)
    loss = np.full((2, e.sizes.size), np.nan)
    some = np.nonzero(e.sizes > 0)[0]
    if some.size and all(totals):
        starts = (np.cumsum(e.lengths) - e.lengths)[some]
        pair_here, word_here = e.in_document(e.pair), e.in_document(e.word)
        before_here = np.concatenate([word_here[-1:], word_here[:-1]])  # a context is the word one event earlier
        before_here[starts] = 1  # the border
        for m, name in enumerate(("background", "target")):
            scale = totals[1] / totals[0] if m == 0 else 1.0
            count = np.zeros(e.keys.size, dtype=np.int64)
            count[e.order] = np.concatenate([unpack(a) for a in answers[name]])
            mine = (e.target[e.doc] == m).astype(np.int64)
            rest = (totals[m] - mine * e.lengths[e.doc]) * scale
            of_word = ((count[e.word] - mine * word_here) * scale + 1) / (rest + vocabulary)
            context = (count[e.before] - mine * before_here) * scale
            both = (count[e.n_words + e.pair] - mine * pair_here) * scale
            cost = -np.log((both + STRENGTH * of_word) / (context + STRENGTH))
            loss[m, some] = np.add.reduceat(cost, starts) / e.lengths[some]
    ids = pd.arrays.IntegerArray(unpack(row["ids"]), unpack(row["known"]) == 0)
    return pd.DataFrame({"id": ids, "n_tokens": e.sizes, "loss_target": loss[1], "loss_background": loss[0],
                         "score": np.nan_to_num(loss[1] - loss[0])})


def lm_scores(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_tokens (words), loss_target, loss_background, score.

    ``target_ids`` holds the ids of the target documents; all others are the background."""
    spark = docs.sparkSession
    index = stage(blocks(docs.select(F.col(id_col).cast("long"), text_col), block_words), "lm-blocks")
    index = with_targets(index, target_ids.select(F.col(id_col).cast("long").alias("id")))
    n_keys = index.agg(F.sum("n_keys")).first()[0] or 0
    shares = max(SHARES * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // SHARE_KEYS))
    answers = stage(questions(index, shares).groupBy("share").applyInPandas(_answer, ANSWERS), "lm-answers")
    sums = answers.agg(F.sum("vocabulary"), F.sum("n_background"), F.sum("n_target")).first()
    vocabulary, *totals = (int(x or 0) for x in sums)

    def scored(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("share")
        return pd.concat([score_block(row, got, shares, vocabulary, totals) for _, row in asked.iterrows()])

    found = index.drop("n_keys").groupBy("block").cogroup(
        answers.select("block", "share", "background", "target").groupBy("block")).applyInPandas(scored, SCORES)
    back = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(F.col("id").alias(id_col), "n_tokens", back("loss_target"), back("loss_background"), "score")
