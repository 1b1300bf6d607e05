"""Language ID by language-bitmask n-gram filters.

Training counts letter n-grams of whole training texts per language in Spark. An n-gram
belongs to a language if its share there reaches ``MIN_SHARE`` and a fixed part of its
largest share in any language. The filter is a bit-sliced Bloom filter: each of its
``CELLS`` cells holds a bitmask of languages; an n-gram sets its languages' bits in
``PROBES`` cells, and the AND of these cells gives all its languages at once. Filling is a
Spark aggregation by cell (bitwise or), so what reaches the driver is at most ``CELLS`` rows,
whatever the corpus.

A text's n-grams are looked up, each language's bits are counted, the count expected from
false positives (the language's fill to the power of the probes) is taken out, and the
largest corrected count decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import FEW_BYTES_AT_ONCE, map_text, quoted, slices, unused, written

ORDERS = (3, 4, 5)
CELL_BITS = 21
CELLS = 1 << CELL_BITS
PROBES = 3
MIN_SHARE = 1e-6
PART_OF_LARGEST = 0.2
#: Languages of one bitmask; more take further slices of the filter, up to so many languages.
SLICE_LANGUAGES = 63
MAX_LANGUAGES = 8 * SLICE_LANGUAGES
#: Distinct n-gram counts that a training task holds before it emits them, entries it gathers before it adds up
#: equal ones (or as many as it holds, if more), and counts it emits at once.
HELD = 1_000_000
GATHER = 400_000
EMIT = 200_000
UNKNOWN = "und"
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (multiply and shift, fixed odd constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of " word " for each word, and the number of the word of each."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    owner = np.cumsum(space) - 1
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        inner = np.zeros(size, bool)
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + size])
            if 0 < k < n - 1:
                inner |= space[k:k + size]
        at = np.flatnonzero(~inner)
        hashes.append(h[at])
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Lower-case letter runs of all texts, and how many each text has."""
    found = [letter_runs(t) for t in texts]
    return (pa.array([w for f in found for w in f], pa.large_utf8()),
            np.fromiter(map(len, found), np.int64, len(found)))


def letter_runs(text: str | None) -> list[str]:
    """The lower-case runs of letters of a text; signs like one half or superscript two are no letters."""
    words = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, h, n): n-gram counts of ``docs`` (lang, text), added up inside each task."""

    def run(batches):
        held: dict[str, list] = {}

        def out(some: dict):
            for lang, parts in some.items():
                keys, counts = added_up(*map(np.concatenate, zip(*parts)))
                for at in range(0, len(keys), EMIT):
                    k = keys[at:at + EMIT]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k)), "h": pa.array(k.view(np.int64)),
                                                      "n": pa.array(counts[at:at + EMIT])})

        size = distinct = 0
        for part in slices(batches, most=FEW_BYTES_AT_ONCE):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                words, _ = words_of([t for t, x in zip(texts, langs) if x == lang])
                tally = words.value_counts()
                keys, owners = grams(tally.field("values").to_numpy(zero_copy_only=False).tolist())
                if len(keys):
                    held.setdefault(lang, []).append(added_up(keys, tally.field("counts").to_numpy()[owners]))
                    size += len(held[lang][-1][0])
            if size > distinct + max(distinct, GATHER):
                for lang, parts in held.items():  # one language after the other: the parts of each go as it is added up
                    held[lang] = [added_up(*map(np.concatenate, zip(*parts)))]
                size = distinct = sum(len(p[0][0]) for p in held.values())
                if distinct > HELD:
                    yield from out(held)
                    held, size, distinct = {}, 0, 0
        yield from out(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, h long, n long")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for one fold in five by the crc32 of the id as text (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    """Learned languages and the filter: for each ``SLICE_LANGUAGES`` languages a row of ``CELLS`` cells of 8 bytes."""

    languages: list[str]
    cells: np.ndarray

    def rates(self) -> np.ndarray:
        """False-positive rate of each language's bits."""
        bits = [np.count_nonzero(self.cells[i // SLICE_LANGUAGES] & np.uint64(1 << i % SLICE_LANGUAGES)) / CELLS
                for i in range(len(self.languages))]
        return np.array(bits) ** PROBES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, a row for each slice of languages."""
        out = self.cells[:, hashes & np.uint64(CELLS - 1)]
        for k in range(1, PROBES):
            out = out & self.cells[:, hashes >> np.uint64(k * CELL_BITS) & np.uint64(CELLS - 1)]
        return out


def train(docs: DataFrame) -> Model:
    """Learn from ``docs`` (lang, text); rows where either is null are not used."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = [r["lang"] for r in usable.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n_slices = max(1, -(-len(names) // SLICE_LANGUAGES))
    cells = np.zeros((n_slices, CELLS), np.uint64)
    if not names:
        return Model([], cells)
    by_gram = gram_counts(usable).groupBy("h").agg(
        *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(names)])
    by_gram = written(by_gram, "grams")
    totals = by_gram.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).first()
    share = [F.col(f"n{i}") / F.lit(float(totals[i] or 1)) for i in range(len(names))]
    largest = F.greatest(*share) if len(share) > 1 else share[0]
    masks = [F.lit(0).cast("long")] * n_slices
    for i, s in enumerate(share):
        bit = F.when((s >= MIN_SHARE) & (s >= largest * PART_OF_LARGEST), F.lit(1 << i % SLICE_LANGUAGES)).otherwise(0).cast("long")
        masks[i // SLICE_LANGUAGES] = masks[i // SLICE_LANGUAGES].bitwiseOR(bit)
    held = [f"mask{k}" for k in range(n_slices)]
    probes = F.array(*[F.shiftrightunsigned("h", k * CELL_BITS).bitwiseAND(F.lit(CELLS - 1)) for k in range(PROBES)])
    filled = (by_gram.select("h", *[m.alias(c) for m, c in zip(masks, held)]).where(" or ".join(f"{c} != 0" for c in held))
              .select(F.explode(probes).alias("cell"), *held).groupBy("cell").agg(*[F.bit_or(c).alias(c) for c in held]))
    table = filled.toArrow()
    for k, c in enumerate(held):
        cells[k, table.column("cell").to_numpy()] = table.column(c).to_numpy().astype(np.uint64)
    return Model(names, cells)


def predictor(model: Model):
    """A function from texts to (languages, scores)."""
    rates = model.rates()
    n_langs = len(model.languages)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, counts = words_of(texts)
        if not n_langs or not len(words):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        coded = words.dictionary_encode()
        hashes, owners = grams(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        masks, distinct = model.masks(hashes), len(coded.dictionary)
        per_word = np.stack([np.bincount(owners, minlength=distinct)] + [
            np.bincount(owners, (masks[i // SLICE_LANGUAGES] >> np.uint64(i % SLICE_LANGUAGES) & np.uint64(1)).astype(float), distinct)
            for i in range(n_langs)], 1)
        sums = np.concatenate((np.zeros((1, n_langs + 1)), np.cumsum(per_word[coded.indices.to_numpy()], 0)))
        edges = np.concatenate(([0], np.cumsum(counts)))
        of_text = sums[edges[1:]] - sums[edges[:-1]]
        total = np.maximum(of_text[:, :1], 1)
        corrected = np.clip((of_text[:, 1:] - total * rates) / np.maximum(1 - rates, 1e-9), 0, None)
        best = corrected.argmax(1)
        score = np.clip(corrected[np.arange(len(texts)), best] / total[:, 0], 0, 1)
        return ([model.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), counts.tolist())],
                [s if c else 0.0 for s, c in zip(score.tolist(), counts.tolist())])

    return predict


def identify(docs: DataFrame, model: Model, columns: list[str], keep_text: bool = False,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs`` plus the predicted language and score (0 to 1: the corrected share of the
    text's n-grams that belong to it). ``und`` and 0 if the text is null or has no letter, or
    nothing was learned; ties go to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.cells))

    def make():
        predict = predictor(Model(*shared.value))
        return lambda texts: dict(zip(names, predict(texts)))

    return map_text(docs, columns, f"{names[0]} string, {names[1]} double", make, keep_text, FEW_BYTES_AT_ONCE)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, learned from the rows of the
    other folds. Extra columns are ignored; an empty table gives no rows."""
    tagged = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(tagged.where(~F.col("held_out")))
    return identify(tagged, model, ["doc_id", "held_out", "text"])


def keep_identified(docs: DataFrame, min_score: float = 0.2) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``min_score``.

    Null and empty texts, and those without a letter, go; repeated rows are judged alike and stay or go together; an
    empty table, or one without a labelled row to learn from, gives no rows. Columns of any name pass unchanged."""
    model = train(docs.where(~held_out()))
    names = (unused("lang_pred", docs.columns), unused("score", docs.columns))
    out = identify(docs, model, docs.columns, True, names)
    return out.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score)).select(*quoted(docs.columns))
