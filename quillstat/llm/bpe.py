"""Byte-level BPE over whole texts by pre-token.

The library spends most of its time merging the same pre-tokens again and again. Here a
batch of texts is cut into pre-tokens with numpy (the rule of byte-level BPE: contractions,
letters, digits, other signs, white space), the distinct ones are found with Arrow's exact
string dictionary, and only those not met before go to the ``tokenizers`` library. Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``:
BPE never merges across pre-tokens, and special strings are cut out first, as the
library does by default. Texts with code points that this Python's Unicode tables do not
know go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER, UNKNOWN, BREAK = 0, 1, 2, 3, 4, 5
#: fixed values: the contractions of the byte-level split, without the apostrophe
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Texts longer than this are cut at a space between words first (bounded memory).
SEGMENT_CHARS = 1 << 20
#: Entries of one generation of the pre-token memory; two generations are kept.
MEMORY = 400_000
CUT = re.compile(r"(?<=\w) (?=\w)")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point (assigned ones; others are UNKNOWN)."""
    first = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        cat = unicodedata.category(chr(c))
        out[c] = UNKNOWN if cat == "Cn" else first.get(cat[0], OTHER)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


@lru_cache(maxsize=1)
def byte_signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(moved)}


def byte_kinds(raw: np.ndarray) -> np.ndarray:
    """Class of every UTF-8 byte: that of the character it belongs to."""
    table = char_classes()
    kind = table[:256].copy()
    kind[128:] = OTHER
    kind = kind[raw]
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        lead = raw[high].astype(np.int32)
        for width, first, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
            of = high[(lead >= first) & (lead < (first >> 1 | 0x80))]
            if len(of):
                code = raw[of].astype(np.int32) & mask
                for k in range(1, width):
                    code = code << 6 | (raw[of + k] & 0x3F)
                own = table[code]
                for k in range(width):
                    kind[of + k] = own
    return kind


def pretokens(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pre-tokens of all texts (none empty), in order, as one string array, how many each
    text has, and the numbers of the texts with unknown code points (whose pre-tokens may be
    wrong)."""
    coded = [t.encode() for t in texts]
    joined = b"\n".join(coded)
    raw = np.frombuffer(joined, np.uint8)
    breaks = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)[:-1] - 1
    kind = byte_kinds(raw)
    odd = np.flatnonzero(kind == UNKNOWN)
    kind[breaks] = BREAK
    starts = np.empty(len(raw) + 1, bool)
    starts[0] = starts[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:-1])
    # the last white space before a sign stands alone or, a plain space, leads the next token
    white = kind == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != BREAK))
    first = last.copy()
    for k in range(3):  # back to its lead byte
        first -= (raw[first] & 0xC0) == 0x80
    starts[first] = True
    starts[last[raw[last] == 32] + 1] = False
    starts[breaks] = starts[breaks + 1] = True
    if b"'" in joined:
        # contractions: an apostrophe that starts a token, letters after it
        marks = np.flatnonzero((raw[:-1] == 39) & starts[:-2] & (kind[1:] == LETTER))
        for p in marks.tolist():
            two = joined[p + 1:p + 3]
            for end in CONTRACTIONS:
                if two.startswith(end):
                    starts[p + 1] = False
                    starts[p + 1 + len(end)] = True
                    break
    at = np.flatnonzero(starts)
    words = pa.Array.from_buffers(pa.large_utf8(), len(at) - 1,
                                  [None, pa.py_buffer(at.astype(np.int64, copy=False)), pa.py_buffer(joined)])
    if not len(breaks):
        return words, np.array([len(at) - 1]), np.arange(len(odd) > 0)
    real = np.ones(len(at) - 1, bool)
    real[np.searchsorted(at, breaks)] = False
    edges = np.searchsorted(at, np.concatenate(([0], breaks + 1, [len(raw) + 1])))
    counts = np.diff(edges) - 1
    return words.filter(pa.array(real)), counts, np.unique(np.searchsorted(breaks, odd))


def segments(text: str) -> Iterator[str]:
    """Pieces of a long text, cut where a pre-token is sure to start."""
    start = 0
    while len(text) - start > SEGMENT_CHARS:
        hit = CUT.search(text, start + SEGMENT_CHARS)
        if hit is None:
            break
        yield text[start:hit.start()]
        start = hit.start()
    yield text[start:] if start else text


class Coder:
    """Encodes texts with the library's vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        self.plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space") and not spec.get("normalizer")
                      and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added))
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if added else None
        self.n_ids = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str | None) -> list[tuple[str, str]]:
        """('plain' | 'special' | 'library', string) in text order."""
        if not text:
            return []
        if not self.plain:
            return [("library", text)]
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(("special", part))
            elif part:
                out.extend(("plain", s) for s in segments(part))
        return out

    def coded(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; those not in memory go to the library in one call."""
        if len(self.new) > MEMORY:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        fresh = [w for w in words if w not in new and w not in old]
        merge, at = self.tok.model.tokenize, 0
        signs = "".join(fresh).encode().decode("latin-1").translate(byte_signs())
        for w in fresh:
            end = at + (len(w) if w.isascii() else len(w.encode()))
            new[w] = array(self.code, [t.id for t in merge(signs[at:end])]).tobytes()
            at = end
        out = []
        for w in words:
            ids = new.get(w)
            if ids is None:
                ids = new[w] = old[w]
            out.append(ids)
        return out

    def words(self, texts: list[str | None]) -> tuple[list[tuple], pa.Array, np.ndarray]:
        """The parts of all texts as (text number, kind, string), the pre-tokens of the plain
        ones, and how many pre-tokens each part has."""
        parts = [(doc, kind, s) for doc, text in enumerate(texts) for kind, s in self.pieces(text)]
        plain = [i for i, p in enumerate(parts) if p[1] == "plain"]
        counts = np.zeros(len(parts), np.int64)
        array = pa.array([], pa.large_utf8())
        if plain:
            array, counts[plain], odd = pretokens([parts[i][2] for i in plain])
            if len(odd):
                for i in odd.tolist():
                    doc, _, s = parts[plain[i]]
                    parts[plain[i]] = (doc, "library", s)
                mine = np.repeat([p[1] == "plain" for p in parts], counts)
                array = array.filter(pa.array(mine))
                counts[[p[1] != "plain" for p in parts]] = 0
        return parts, array, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (null: none) in one array of ``dtype``, and each text's number of ids."""
        parts, words, counts = self.words(texts)
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy()
        held = self.coded(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // self.dtype.itemsize
        each = lengths[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        store = np.frombuffer(b"".join(held), self.dtype)
        flat = store[np.repeat(base[index] - ends[:-1], each) + np.arange(ends[-1])]
        edges = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
        sizes = np.diff(edges)
        if any(p[1] != "plain" for p in parts):
            chunks = [flat[edges[i]:edges[i + 1]] for i in range(len(parts))]
            for i, (_, kind, s) in enumerate(parts):
                if kind != "plain":
                    chunks[i] = np.array([self.special[s]] if kind == "special" else self.library(s), self.dtype)
                    sizes[i] = len(chunks[i])
            flat = np.concatenate(chunks)
        docs = np.fromiter((p[0] for p in parts), np.int64, len(parts))
        return flat, np.bincount(docs, sizes, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder per Python worker and vocabulary."""
    return Coder(path)
