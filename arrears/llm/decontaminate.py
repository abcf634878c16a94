"""Benchmark decontamination over a stored positional inverted index.

``build_index`` turns documents into index blocks of about ``block_words`` words (a document
is never split). A block row holds its own inverted index: the sorted terms, and for each
term the list of positions where it stands. Blocks are self-contained rows of a stored
table, so a search runs over them in parallel without any shuffle, and one stored index
serves many benchmarks.

``search`` cuts every item into windows of consecutive words. For a window it takes the
posting list of the rarest term in the block, shifts it by the term's offset, and
intersects it with the shifted lists of the other terms from rare to frequent; what remains
are the exact places of the phrase. Neighbouring windows of an item merge into spans.
``proximity=True`` also reports places where all words of a whole window stand, each as often
as in the window and in any order, within ``slop`` extra words.

Items are dealt by hash into shares of about ``PASS_BYTES`` of text. A share is a row that
meets the blocks in a join, so neither the driver nor a task holds more than a share of the
benchmark; the spans of several shares are united per document.

Edge cases: null or word-less texts give a row without matches; word-less items have no
windows; an item shorter than the window is one window, found as a phrase only; equal windows
of several items match for each of them; an item without id marks its places but is neither
listed nor counted in the digest. Null ids and repeated rows are kept as they are. Empty tables give empty or
match-free results. Extra columns of either input are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import stage, words

WINDOW = 10
BLOCK_WORDS = 400_000
PASS_BYTES = 16_000_000
SPANS = "array<struct<item_id:bigint,start:bigint,end:bigint,kind:string>>"
INDEX = "block string, doc_ids array<bigint>, starts binary, terms binary, bounds binary, postings binary"
FOUND = f"block string, ordinal int, doc_id bigint, n_words bigint, matches {SPANS}"


def _block_row(name: str, ids: list, docs: list[list[bytes]]) -> dict:
    """Inverted index of some documents. Positions run through the block, with one free
    place after each document so that no phrase crosses a border."""
    codes: dict[bytes, int] = {}
    starts = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=starts[1:])
    terms = np.fromiter((codes.setdefault(w, len(codes)) for d in docs for w in d), dtype=np.int32)
    places = np.arange(terms.size, dtype=np.int32) + np.repeat(
        np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    order = np.argsort(terms, kind="stable")
    bounds = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(np.bincount(terms, minlength=len(codes)), out=bounds[1:])
    return {"block": name, "doc_ids": ids, "starts": starts.tobytes(), "terms": b" ".join(codes),
            "bounds": bounds.tobytes(), "postings": places[order].tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """Index blocks (see INDEX); store them before searching."""

    def index(batches):
        import uuid

        ids, held, n = [], [], 0
        schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.binary()),
                            ("terms", pa.binary()), ("bounds", pa.binary()), ("postings", pa.binary())])
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                found = words(text.as_py())
                ids.append(i.as_py())
                held.append(found)
                n += len(found) + 1
                if n >= block_words:
                    yield pa.RecordBatch.from_pylist([_block_row(uuid.uuid4().hex, ids, held)], schema)
                    ids, held, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block_row(uuid.uuid4().hex, ids, held)], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(index, INDEX)


def item_windows(items: list[tuple[int, str]], size: int) -> dict[tuple[bytes, ...], list[int]]:
    """Distinct windows and the items that hold them."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for item, text in items:
        found = words(text)
        for k in range(max(1, len(found) - size + 1) if found else 0):
            out.setdefault(tuple(found[k:k + size]), []).append(item)
    return out


def _phrase(lists: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Starts at which every list has its offset: intersect from the shortest list on."""
    lists = sorted(lists, key=lambda x: x[0].size)
    at = lists[0][0] - lists[0][1]
    for posting, offset in lists[1:]:
        if not at.size:
            break
        want = at + offset
        k = np.searchsorted(posting, want)
        at = at[posting[np.minimum(k, posting.size - 1)] == want]
    return at


def _near(lists: list[tuple[np.ndarray, int]], reach: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Spans of at most ``reach`` words of one document that hold of every list as many places
    as it asks for. Each place of the rarest list is tried with every window start that could
    cover it; places without enough of a list in their document and reach are left out
    beforehand, all at once."""
    lists = sorted(lists, key=lambda x: x[0].size)
    at = lists[0][0]
    doc = np.searchsorted(starts, at, side="right") - 1
    low = np.maximum(at - reach + 1, starts[doc]).astype(at.dtype)
    high = np.minimum(at + reach, starts[doc + 1] - 1).astype(at.dtype)
    for x, need in lists:
        if not at.size:
            break
        held = np.searchsorted(x, high) - np.searchsorted(x, low) >= need
        at, low, high = at[held], low[held], high[held]
    ranges = [(np.searchsorted(x, low).tolist(), np.searchsorted(x, high).tolist()) for x, _ in lists]
    out = []
    for k, p in enumerate(at.tolist()):
        near = [(x[i[k]:j[k]].tolist(), need) for (x, need), (i, j) in zip(lists, ranges)]
        for a in sorted({v for x, _ in near for v in x if v <= p}):
            last = [bisect_left(x, a) + need - 1 for x, need in near]
            if any(n >= len(x) for n, (x, _) in zip(last, near)):
                break  # a later start holds no more
            end = max(p, *(x[n] for n, (x, _) in zip(last, near)))
            if end - a < reach:
                out.append((a, end + 1))
                break
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_block(row: dict, windows: dict, size: int, proximity: bool, slop: int):
    """Matches of all windows in one index block: {(ordinal, item, kind): spans in words}."""
    names = row["terms"].split(b" ") if row["terms"] else []
    code = {w: k for k, w in enumerate(names)}
    bounds = np.frombuffer(row["bounds"], dtype=np.int64)
    postings = np.frombuffer(row["postings"], dtype=np.int32)
    starts = np.frombuffer(row["starts"], dtype=np.int64)
    found: dict[tuple[int, int, str], list[tuple[int, int]]] = {}

    def note(at: int, end: int, kind: str, items: list[int]) -> None:
        doc = int(np.searchsorted(starts, at, side="right")) - 1
        if end < starts[doc + 1]:
            for item in items:
                found.setdefault((doc, item, kind), []).append((at - int(starts[doc]), end - int(starts[doc])))

    for window, items in windows.items():
        terms = [code.get(w, -1) for w in window]
        if min(terms) < 0:
            continue
        lists = [postings[bounds[t]:bounds[t + 1]] for t in terms]
        for at in _phrase([(x, k) for k, x in enumerate(lists)]).tolist():
            note(at, at + len(window), "phrase", items)
        if proximity and len(window) == size:
            wanted = [(postings[bounds[t]:bounds[t + 1]], n) for t, n in Counter(terms).items()]
            for a, b in _near(wanted, size + slop, starts):
                note(a, b, "near", items)
    return {k: _merge(v) for k, v in found.items()}, starts


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, proximity: bool = False, slop: int = 5) -> DataFrame:
    """One row per indexed document: block, ordinal, doc_id, n_words, matches (SPANS; word
    offsets in the document, ``end`` excluded)."""
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    n_bytes = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-int(n_bytes) // PASS_BYTES))
    shares = items.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(passes)).cast("int").alias("share")).agg(
        F.collect_list(F.struct("i", "t")).alias("items"))  # about PASS_BYTES
    asked = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).join(shares, "share", "left")
    found = asked.mapInArrow(_searcher(window, proximity, slop), FOUND)
    if passes == 1:
        return found
    return found.groupBy("block", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"))


def _searcher(window: int, proximity: bool, slop: int):
    """Search of index blocks for the share of items beside them."""
    schema = pa.schema([("block", pa.string()), ("ordinal", pa.int32()), ("doc_id", pa.int64()),
                        ("n_words", pa.int64()), ("matches", pa.list_(pa.struct([
                            ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                            ("kind", pa.string())])))])

    def run(batches):
        share, windows = None, {}
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if share != row["share"]:
                    share, windows = row["share"], item_windows([(x["i"], x["t"]) for x in row["items"] or ()], window)
                found, starts = search_block(row, windows, window, proximity, slop)
                by_doc: dict[int, list] = {}
                for (doc, item, kind), spans in found.items():
                    by_doc.setdefault(doc, []).extend(
                        {"item_id": item, "start": a, "end": b, "kind": kind} for a, b in spans)
                sizes = np.diff(starts) - 1
                yield pa.RecordBatch.from_pylist(
                    [{"block": row["block"], "ordinal": k, "doc_id": i, "n_words": int(sizes[k]),
                      "matches": by_doc.get(k, [])} for k, i in enumerate(row["doc_ids"])], schema)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """Store the index of the documents and search it for all items."""
    return search(stage(build_index(docs, id_col, text_col), "postings"), items, window=window, proximity=proximity)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the phrase matches;
    n_near, near_sha256 (items with a near match) from the proximity matches."""

    def listed(spans, kind):
        return sorted({s["item_id"] for s in spans if s["kind"] == kind and s["item_id"] is not None})

    @F.pandas_udf("struct<n_hit:bigint,n_items:bigint,items_sha256:string,n_near:bigint,near_sha256:string>")
    def sums(matches: pd.Series) -> pd.DataFrame:
        out = []
        for spans in matches:
            items, near = listed(spans, "phrase"), listed(spans, "near")
            hit = sum(b - a for a, b in _merge([(s["start"], s["end"]) for s in spans if s["kind"] == "phrase"]))
            out.append((hit, *(x for ids in (items, near) for x in (
                len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))))
        return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256", "n_near", "near_sha256"])

    # As strings: pandas would turn ids beside a null into floats.
    named = F.transform("matches", lambda m: m.withField("item_id", m["item_id"].cast("string")))
    return found.withColumn("d", sums(named)).select(
        "doc_id", "n_words", "d.n_hit", "d.n_items", "d.items_sha256", (F.col("d.n_hit") > 0).alias("contaminated"),
        "d.n_near", "d.near_sha256")
