"""Spelling variants by a bit-sliced position index.

Words are near if one inserted, deleted or replaced code point makes them equal. A block of the
vocabulary is indexed by one bitset per (position, letter): bit k says that word k has the letter
there. A word runs over all words of the block at once: it carries the set of words that agree so far,
and the sets with one error so far (a replaced letter, a letter too many, a letter too few, which
read the index one position further on or back), by ANDs and ORs of whole bitsets.

Blocks: let L be the length of the longer of two near words and p = (L - 1) // 2. They agree in their
first p letters or in their last p. So a word stands in four blocks: by first and by last letters, for L its
own length and its own plus one. Blocks by last letters hold the words reversed. A pair is counted in the
block of its L, by first letters where these agree, and only otherwise by last ones. Blocks of more than
``BLOCK_WORDS`` words are compared as pairs of slices in tasks of their own; no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.blocks import HIGH, LOW, OWN, dealt, groups, paired_slices
from quillstat.llm.common import slices, written

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form occurs at least this many times as often as its variant.
FORM_RATIO = 10
#: One run of a document in so many, by its hash, loses a letter.
TYPO_EVERY = 31
BLOCK_WORDS = 16_384
#: A task holds so many counted words before it hands them on.
WORDS_HELD = 200_000
ROWS_OUT = 50_000


def runs_of(text: str, pattern: re.Pattern) -> Counter:
    """The letter runs of a text with A-Z lower-cased and their counts."""
    return Counter(pattern.findall(text.encode().lower().decode()))  # bytes.lower: ASCII only


def with_typo(run: str, doc: bytes, every: int = TYPO_EVERY) -> str:
    """``run``, without a letter if ``every`` divides h = crc32 of ``<doc>:<run>``: that at h % length."""
    h = zlib.crc32(doc + b":" + run.encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_column: str = "doc_id", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word string, n long): the words of ``text`` with at least ``min_letters`` code points and
    ``min_count`` occurrences over all rows.

    A null text has no words. The id (any type; null as the empty text) goes into the hash as text. A row that
    is repeated counts as often as it stands. Texts are taken whole."""
    def count(batches):
        pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{min_letters},}}")
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                key = (doc or "").encode()
                for run, n in runs_of(text, pattern).items():
                    word = with_typo(run, key, typo_every)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= WORDS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.col(id_column).cast("string").alias("id"), "text")
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def block_keys(word: Column) -> Column:
    """The four (block, side, longest) of a word; ``side`` 1 is by last letters."""
    def of(side: int, more: int):
        longest = F.char_length(word) + more
        p = F.floor((longest - 1) / 2).cast("int")
        ends = F.substring(word, F.lit(1), p) if not side else F.right(word, p)
        return F.struct(F.concat_ws(":", F.lit(side).cast("string"), longest.cast("string"), ends).alias("block"),
                        F.lit(side).alias("side"), longest.alias("longest"))

    return F.array(*[of(side, more) for side in (0, 1) for more in (0, 1)])


class PositionIndex:
    """Bitsets of a block of words, which all agree in their first ``start`` letters and
    have ``longest`` or ``longest - 1`` letters. Bit k stands for the k-th word."""

    def __init__(self, words: list[str], longest: int, start: int):
        self.longest, self.start = longest, start
        self.all = (1 << len(words)) - 1
        self.at: list[dict[str, int]] = [defaultdict(int) for _ in range(longest + 1)]
        self.long = 0
        places: list[dict[str, bytearray]] = [{} for _ in range(longest)]
        size = (len(words) + 7) // 8
        long = bytearray(size)
        for k, word in enumerate(words):
            byte, bit = k >> 3, 1 << (k & 7)
            if len(word) == longest:
                long[byte] |= bit
            for i in range(start, len(word)):
                held = places[i].get(word[i])
                if held is None:
                    held = places[i][word[i]] = bytearray(size)
                held[byte] |= bit
        self.long = int.from_bytes(long, "little")
        for i, letters in enumerate(places):
            for letter, held in letters.items():
                self.at[i][letter] = int.from_bytes(held, "little")

    def near(self, word: str, but: int = 0) -> int:
        """The set of words one error away from ``word``, of which one has ``longest``
        letters; without the words of the set ``but``."""
        same, at = self.all & ~but, self.at
        if len(word) == self.longest:
            replaced = short = 0  # one replaced; the index word lacks a letter of ``word``
            for i in range(self.start, len(word)):
                here = at[i].get(word[i], 0)
                back = at[i - 1].get(word[i], 0)
                replaced, short, same = (replaced & here) | (same & ~here), (short & back) | same, same & here
                if not (replaced or short):
                    return 0
            return (replaced & self.long) | (short & ~self.long)
        more = 0  # the index word has a letter that ``word`` lacks
        for i in range(self.start, len(word)):
            more = (more | same) & at[i + 1].get(word[i], 0)
            same &= at[i].get(word[i], 0)
            if not (more or same):
                return 0
        return (more | same) & self.long


def near_in_block(longest: int, side: int, index: list[tuple[int, str]], asking: list[str], same: bool):
    """(word, near words, n and text of the most frequent near word) of each of ``asking`` that
    has near words in ``index``, which is in order of n (largest first), then word.

    ``same``: asking are the words of the index, in its order."""
    p = (longest - 1) // 2
    words = [w for _, w in index]
    turned = [w[::-1] for w in words] if side else words
    block = PositionIndex(turned, longest, p)
    heads: dict[str, int] = defaultdict(int)
    if side:  # pairs that agree in their first letters too are counted there
        for k, w in enumerate(words):
            heads[w[:p]] |= 1 << k
    for k, word in enumerate(asking):
        but = heads.get(word[:p], 0) | (1 << k if same else 0)
        found = block.near(word[::-1] if side else word, but)
        if found:
            n, best = index[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), n, best


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``words`` (word, n; distinct) to (word, n_near, near_n, near_word): the number of near words and the
    most frequent of them (ties: the smallest). Words without near words are not listed."""
    keyed = words.select("word", "n", F.explode(block_keys(F.col("word"))).alias("key")).select("key.*", "word", "n")
    rows = paired_slices(keyed, "block", F.col("word"), block_words).select("block", LOW, HIGH, "side", "longest", OWN, "n", "word")

    def run(batches):
        out: list[tuple] = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                              names=["word", "n_near", "near_n", "near_word"])
            out.clear()
            return made

        for group in groups(batches, 3):
            if len(group) == 1:
                continue
            _, low, high, side, longest = group[0][:5]
            parts = {s: [r[6:] for r in group if r[5] == s] for s in {low, high}}
            index, asking = parts[low], parts[high]
            out.extend(near_in_block(longest, side, index, [w for _, w in asking], low == high))
            if low != high:
                out.extend(near_in_block(longest, side, asking, [w for _, w in index], False))
            if len(out) >= ROWS_OUT:
                yield batch()
        if out:
            yield batch()

    found = dealt(rows, "block", F.desc("n"), "word").mapInArrow(run, "word string, n_near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word"))).alias("best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near_word")))


def last_forms(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) to (word, root), the last of a chain of forms. A form occurs more often
    than its word, so chains end; each round doubles the steps taken."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = state.join(ahead, "root", "left")
        moved = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = FORM_RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``words`` (word, n) to (word, form, root, n, n_near, form_n).

    The form is the most frequent near word (ties: the smallest in code-point order) if it occurs at
    least ``ratio`` (over 1) times as often as the word, else null; the root is the last of the chain
    of forms, the word itself if it has none. Null words are left out, repeated rows are added up, an
    empty table gives no rows. Words are compared by code points whatever they are made of."""
    if ratio <= 1:
        raise ValueError("a form has to be more frequent than its word")
    words = written(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    named = written(words.join(near_words(words, block_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = last_forms(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The variants of the words of ``docs`` (doc_id, text), as ``word_counts`` and ``variants`` state.
    Other columns, of any names, are not read; an empty table gives no rows."""
    return variants(word_counts(docs), block_words=block_words)
