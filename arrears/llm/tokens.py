"""Token ids of whole texts by the tokenizers library, with caches.

``text_encoder`` picks the way from the tokenizer's definition. Where white space is dropped,
the ids of a text are those of its white-space separated pieces in order (``PieceEncoder``).
Where a byte-level tokenizer keeps it, they are those of its runs of white space with the word
after them (``SpacedEncoder``). Any other tokenizer gets whole texts (``WholeEncoder``). What
has been seen comes from a cache that all tasks of a Python worker share.

A tokenizer whose pipeline is NFC, white space, lower case / one split pattern / byte level /
BPE gets a shorter way for pieces of Latin letters: the pattern cuts them here and the
library's BPE model merges each part. Any other piece, and any other tokenizer, takes the
library's whole pipeline.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

CACHE_PIECES = 400_000
SPACED_PARTS = 700_000
#: Characters below this one take the short way; their case and letter rules are stable.
LATIN_END = "ɐ"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in
    order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = (b for b in range(256) if b not in plain)
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(other)}}


def split_pattern(spec: dict) -> str | None:
    """The split pattern of a tokenizer that allows the short way."""
    steps = [s.get("type") for s in ((spec.get("normalizer") or {}).get("normalizers") or [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    cut = before[0] if before else {}
    if steps == ["NFC", "Replace", "Lowercase"] and [b.get("type") for b in before] == ["Split", "ByteLevel"] \
            and cut.get("invert") and cut.get("behavior") == "Removed" and not before[1].get("add_prefix_space") \
            and not before[1].get("use_regex") and spec["model"].get("type") == "BPE":
        return cut["pattern"].get("Regex")
    return None


class PieceEncoder:
    """ids of texts; ``definition`` is the tokenizer's JSON."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.known: dict[bytes, bytes] = {}
        pattern = split_pattern(spec)
        self.pattern = regex.compile(pattern) if pattern else None
        self.special = {t["content"][0] for t in spec.get("added_tokens", [])}
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """ids of each text (UTF-8) as little-endian integers of ``dtype``; none for null."""
        out = []
        for k in range(0, len(texts), 64):
            split = [t.split() if t else [] for t in texts[k:k + 64]]
            self._learn({p for pieces in split for p in pieces})
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        return out

    def _learn(self, pieces: set[bytes]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            # The first pieces seen are the common ones: keep the older half.
            self.known = dict(islice(self.known.items(), CACHE_PIECES // 2))
            new = pieces.difference(self.known)
        rest = []
        for p in new:
            if p in self.known:  # came as a part of another piece
                continue
            if self.pattern is None:
                rest.append(p.decode())
            elif p.isalpha():  # ASCII letters only: one part
                self.known[p] = self._part(p.lower())
            elif max(text := p.decode()) < LATIN_END and self.special.isdisjoint(text):
                self.known[p] = self._short(text)
            else:
                rest.append(text)
        if rest:
            found = self.tokenizer.encode_batch(rest, add_special_tokens=False)
            self.known.update((t.encode(), np.array(e.ids, dtype=self.dtype).tobytes()) for t, e in zip(rest, found))

    def _short(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return b"".join([self._part(x.encode()) for x in self.pattern.findall(text)])

    def _part(self, part: bytes) -> bytes:
        """ids of one part of the split, merged by the library's BPE model. A part is a piece
        of its own as well, so it shares the cache."""
        ids = self.known.get(part)
        if ids is None:
            word = part.decode() if part.isalnum() else "".join([self.letters[b] for b in part])
            ids = array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
            self.known[part] = ids
        return ids


class WholeEncoder:
    """ids of texts by the library's whole pipeline."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        found = self.tokenizer.encode_batch([(t or b"").decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]


#: Fixed value: characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def latin_split() -> re.Pattern:
    """The split of byte-level BPE (letters, digits, others, each with one space before; endings
    after an apostrophe; white space but for the last before a word) with plain classes of the
    characters below ``LATIN_END``, which the re module matches fast."""
    kinds: dict[str, str] = {}
    for c in map(chr, range(ord(LATIN_END))):
        kinds[unicodedata.category(c)[0]] = kinds.get(unicodedata.category(c)[0], "") + re.escape(c)
    letters, digits, white = kinds["L"], kinds["N"], "\t-\r \x85\xa0"
    return re.compile(f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{digits}]+| ?[^{white}{letters}{digits}]+"
                      f"|[{white}]+(?![^{white}])|[{white}]+")


class _Known(dict):
    """ids of what has been seen; anything else is learned on the way."""

    def __init__(self, learn, seen=()):
        super().__init__(seen)
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.learn(key)
        return ids


class SpacedEncoder(WholeEncoder):
    """Byte-level BPE that keeps white space. Latin texts are split here and the library's BPE
    model merges each part. The split never joins a character to white space
    after it, so in other texts a run of white space with the word after it goes to the library
    on its own. Texts that hold a special token go there whole."""

    def __init__(self, definition: str):
        super().__init__(definition)
        self.special = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.wide = re.compile(f"[{LATIN_END}-\U0010ffff]").search
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.cut = latin_split().findall
        self.split, self.merge = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.known, self.parts = _Known(self._chunk), _Known(self._part)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        out = []
        for t in texts:
            text = (t or b"").decode()
            if any(s in text for s in self.special):
                out += super().encode([t])
            elif self.wide(text):
                self.known = self._trimmed(self.known)
                out.append(b"".join(map(self.known.__getitem__, self.chunks(text))))
            else:
                self.parts = self._trimmed(self.parts)
                out.append(b"".join(map(self.parts.__getitem__, self.cut(text))))
        return out

    def _trimmed(self, known: _Known) -> _Known:
        """The first seen are the common ones: the older half stays in a full cache."""
        full = len(known) > SPACED_PARTS
        return _Known(known.learn, islice(known.items(), SPACED_PARTS // 2)) if full else known

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self._merged(p) for p, _ in self.split(chunk)])

    def _part(self, part: str) -> bytes:
        """ids of one part of the split."""
        if part.isascii():
            return self._merged(part.translate(self.letters))
        return self._merged("".join([self.letters[b] for b in part.encode()]))

    def _merged(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()


#: Steps that work inside a word only, and pre-tokenizers that drop white space.
INSIDE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
DROPS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if not part else part.get(inner) or [part]


def drops_white_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its white-space separated pieces."""
    if any(set(t["content"]) & set(" \t\n\v\f\r") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
           for t in spec.get("added_tokens", [])):
        return False
    if split_pattern(spec) is not None:
        return True
    before = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    return bool(before) and before[0].get("type") in DROPS and all(
        s.get("type") in INSIDE for s in _steps(spec.get("normalizer"), "normalizers"))


def keeps_words_apart(spec: dict) -> bool:
    """Whether a tokenizer is byte-level BPE with the library's own split and nothing before it."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])))


@lru_cache(maxsize=4)
def text_encoder(definition: str):
    """The worker's encoder of a tokenizer: ``encode(texts)`` and ``dtype``."""
    spec = json.loads(definition)
    if drops_white_space(spec):
        return PieceEncoder(definition)
    return SpacedEncoder(definition) if keeps_words_apart(spec) else WholeEncoder(definition)


def definition(path: str) -> str:
    """The tokenizer file, read once on the driver and sent to the tasks (fixed size)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
