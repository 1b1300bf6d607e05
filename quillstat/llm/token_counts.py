"""Token counts with the whole-token shortcut.

Before any text is read, every vocabulary string is tried: those that form one pre-token and
that the library encodes as exactly one token are proven whole. A text's pre-tokens that
are in this set count one each; only the rest is merged by the library, each distinct
one once while a worker remembers it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.bpe import MEMORY, Coder, byte_signs, coder, pretokens
from quillstat.llm.common import map_text


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that alone are one pre-token and one token (proven by encoding them)."""
    code = coder(path)
    if not code.plain:
        return frozenset()
    back = {sign: byte for byte, sign in byte_signs().items()}
    strings = []
    for token in code.tok.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(back[sign] for sign in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # special strings, and tokens that hold a part of a character
    strings = [s for s in strings if s and s not in code.special]
    words, counts, odd = pretokens(strings)
    odd = set(odd.tolist())
    alone = [s for i, (s, n) in enumerate(zip(strings, counts.tolist())) if n == 1 and i not in odd]
    return frozenset(s for s, e in zip(alone, code.tok.encode_batch_fast(alone, add_special_tokens=False))
                     if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts; one per task, its memory bounded."""

    def __init__(self, path: str):
        self.code: Coder = coder(path)
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        self.merged: dict[str, int] = {}

    def sizes(self, words: list[str]) -> list[int]:
        if len(self.merged) > 2 * MEMORY:
            self.merged = {}
        whole, merged = self.whole, self.merged
        rest = [w for w in words if w not in whole and w not in merged]
        signs, at, merge = "".join(rest).encode().decode("latin-1").translate(byte_signs()), 0, self.code.tok.model.tokenize
        for w in rest:
            end = at + (len(w) if w.isascii() else len(w.encode()))
            merged[w] = len(merge(signs[at:end]))
            at = end
        return [whole[w] if w in whole else merged[w] for w in words]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        parts, words, counts = self.code.words(texts)
        coded = words.dictionary_encode()
        sizes = np.array(self.sizes(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))
        of_part = np.diff(ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64))
        for i, (_, kind, s) in enumerate(parts):
            if kind != "plain":
                of_part[i] = 1 if kind == "special" else len(self.code.library(s))
        docs = np.fromiter((p[0] for p in parts), np.int64, len(parts))
        return np.bincount(docs, of_part, len(texts)).astype(np.int64)


def pieces_counter(path: str):
    """The same for a sentencepiece vocabulary: the library itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: np.array([len(ids) for ids in model.encode([t or "" for t in texts], num_threads=1)], np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text is empty: no bytes, no tokens. Repeated rows are counted each; an empty table
    gives no rows; other columns of ``docs`` are ignored whatever their names."""
    keep = list(keep)
    sized = docs.select(*keep, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")

    def make():
        count = pieces_counter(vocabulary) if vocabulary.endswith(".model") else Counter(vocabulary)
        return lambda texts: {"n_tokens": pa.array(count(texts), pa.int64())}

    counted = map_text(sized, [*keep, "n_bytes", "text"], "n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
