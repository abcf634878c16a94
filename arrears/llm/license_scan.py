"""Fuzzy search for short licence notices.

A notice of m characters allows k = m // 8 edits (words under 11 characters: none), at most
three, and none inside a word of three letters or fewer. By the pigeonhole principle one of k + 1 pieces of the notice occurs unchanged in
every match, so exact searches for the pieces give all candidates. Around each candidate the
regex library matches the notice with at most k edits between word borders and reports the
span and the number of edits.

Texts are compared as words (lower-cased A-Z, digits and non-ASCII) joined by one space, so
line breaks and punctuation never hide a notice. Whole texts are searched.

Edge cases: null and blank texts have no words, no matches and score 0. Overlapping matches
of different notices are all reported. Repeated rows give repeated results. The result
column replaces an input column of the same name.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import words

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"),
        ("cc by", "cc-by"), ("mit license", "mit"))
#: Further short notices of common licences, found with the same bounded errors.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("gnu lesser general public license", "lgpl"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "proprietary"),
)
#: Words of at most so many letters take no edit: "it license" is no "mit license".
EXACT_LETTERS = 3
RESULT = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,"
          "base_labels:array<string>,labels:array<string>,score:double,"
          "spans:array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,text:string>>>")


def edits_allowed(phrase: str) -> int:
    return 0 if len(phrase) < 11 else min(3, len(phrase) // 8)


@lru_cache(maxsize=None)
def _plan(phrase: str):
    """Edits, pieces with their offsets, and the verifying pattern of a notice."""
    k = edits_allowed(phrase)
    cut = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    pieces = [(phrase[a:b].encode(), a) for a, b in zip(cut, cut[1:])]
    body = regex.escape(phrase, literal_spaces=True)
    return k, pieces, regex.compile(rf"(?e)(?<![^ ])(?:{body}){{e<={k}}}(?![^ ])".encode())


def _short_words(phrase: str) -> list[bytes]:
    return [w.encode() for w in phrase.split() if len(w) <= EXACT_LETTERS]


def _holds(found: bytes, short: list[bytes]) -> bool:
    """Whether the short words stand unchanged, in order, among the words found."""
    left = iter(found.split(b" "))
    return all(w in left for w in short)


def _places(hay: bytes, needle: bytes):
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def fuzzy_spans(line: bytes, phrase: str) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches of a notice in space-joined words."""
    k, pieces, pattern = _plan(phrase)
    size, short = len(phrase), _short_words(phrase)
    windows = sorted((max(0, at - off - k - 1), at - off + size + k + 1)
                     for piece, off in pieces for at in _places(line, piece))
    merged: list[list[int]] = []
    for a, b in windows:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    found = []
    for a, b in merged:
        # Lookarounds see the bytes outside of pos and endpos only on the left: stop at a border.
        end = line.find(b" ", min(b, len(line)))
        for m in pattern.finditer(line, a, len(line) if end < 0 else end):
            if m.end() > m.start() and _holds(m[0], short):
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def scan_text(text: str | None, base=BASE, notices=NOTICES) -> dict:
    """Everything the scan knows about one text."""
    parts = words(text)
    line = b" ".join(parts)
    padded = b" " + line + b" "
    word_at = lambda at: line.count(b" ", 0, at)
    starts, base_labels, spans, score = [], set(), [], 0.0
    for phrase, label in base:
        hits = list(_places(padded, f" {phrase} ".encode()))
        if hits:
            base_labels.add(label)
            starts += [hits[0], hits[-1]]
            score = 1.0
        spans += [(label, at, at + len(phrase), 0) for at in hits]
    n_base = len(spans)
    exact = {(a, label) for label, a, _, _ in spans}
    for phrase, label in (*base, *notices):
        for a, b, edits in fuzzy_spans(line, phrase):
            score = max(score, 1 - edits / len(phrase))
            if (a, label) not in exact:
                spans.append((label, a, b, edits))
    spans.sort(key=lambda s: (s[1], s[0], s[2]))
    out, at, word = [], 0, 0
    for label, a, b, edits in spans:
        word, at = word + line.count(b" ", at, a), a
        out.append({"label": label, "first_word": word, "last_word": word + line.count(b" ", a, b),
                    "edits": edits, "text": line[a:b].decode("utf-8", "replace")})
    return {
        "n_words": len(parts), "n_base": n_base,
        "first_word": word_at(min(starts)) if starts else None,
        "last_word": word_at(max(starts)) if starts else None,
        "base_labels": sorted(base_labels),
        "labels": sorted(base_labels | {s[0] for s in spans}),
        "score": score, "spans": out,
    }


def license_scan(docs: DataFrame, text_col: str = "text", out_col: str = "licenses",
                 base=BASE, notices=NOTICES) -> DataFrame:
    """Input columns plus one struct: counts, first and last word, labels, score, spans."""

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        out = pd.DataFrame([scan_text(t, base, notices) for t in texts], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(out_col, scan(F.col(text_col)))
