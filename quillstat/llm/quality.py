"""Quality rules with compression bands.

Base figures are counted per text (words, symbols, repeated lines, words in repeated
three-word windows). The method's verdict comes from zstandard: the ratio of raw to
compressed bytes of the whole text, and of its chunks, must lie in a band. Above it a
text is repetitive, below it is incompressible (random strings, encoded binary data). What is
usual depends on the length (a short text has little to refer back to), so the band does too.

Words of random letters compress about as well as prose, as few letters occur, but only by
that: their compressed size stays above what coding each byte by its frequency needs, and
their letters are more evenly used than in any prose. Chunks of ASCII letters are held against both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import map_text, quoted, unused

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 4096
#: Chunks start at every ``CHUNK_STEP`` bytes, so that a foreign part never halves on a border.
CHUNK_STEP = CHUNK_BYTES // 2
#: (bytes, lowest ratio), read between by the logarithm of the length and constant outside: above base64
#: (1.13 at 384 bytes, 1.18, 1.22, 1.26, 1.30 and 1.31 at 512, 768, 1,024, 2,048 and 4,096), below prose.
FLOOR = ((128, 0.0), (129, 0.95), (256, 1.1), (384, 1.18), (512, 1.26), (768, 1.34), (1024, 1.42), (2048, 1.5), (4096, 1.55))
#: (up to this many bytes, highest ratio) of whole texts and of chunks.
DOCUMENT_TOPS = ((1024, 3.0), (4096, 3.5), (16_384, 4.0), (None, 5.0))
CHUNK_TOPS = ((128, 3.0), (1024, 3.5), (None, 4.0))
#: (bytes, gain): random letters stay below this gain (bytes that coding by frequency needs, through compressed bytes).
RANDOM_GAIN = ((256, 0.8), (384, 0.855), (512, 0.885), (768, 0.92), (1024, 0.945), (2048, 0.97), (4096, 0.99))
#: Bits a letter: English, French, German and Spanish need 3.6 to 4.2, evenly drawn letters 4.4 to 4.7.
RANDOM_BITS = 4.34
#: A chunk of over ``CHUNK_STEP`` bytes below this gain repeats nothing, whatever its letters (hexadecimal digits).
LEAST_GAIN = 0.96
#: The tests of gain are for chunks with at most this share of non-ASCII bytes (other scripts have other figures).
OTHER_BYTES = 0.1
#: A text fails when more than this share of its bytes lies in chunks out of the band.
BAD_CHUNK_SHARE = 0.15
MIN_WORDS = 50
REPEAT_PERCENT = 50

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_ratio double, "
          "bad_chunk_share double, base_failed boolean, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    pair = code[:-2] * size + code[1:-1]
    if size > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair * size + code[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


def between(points: tuple, size: int) -> float:
    return float(np.interp(np.log2(size), *POINTS[points]))


POINTS = {points: (np.log2([n for n, _ in points]), [y for _, y in points]) for points in (FLOOR, RANDOM_GAIN)}


def top_of(tops: tuple, size: int) -> float:
    return next(high for top, high in tops if top is None or size <= top)


def bits(counts: np.ndarray) -> float:
    """Entropy of the counts' shares."""
    counts = counts[counts > 0]
    n = counts.sum()
    return float((counts * np.log2(n / counts)).sum() / n)


def random_letters(raw: bytes, compressed: int) -> bool:
    values = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    if values[128:].sum() > OTHER_BYTES * len(raw):
        return False
    gain = bits(values) * len(raw) / 8 / compressed
    if len(raw) > CHUNK_STEP and gain < LEAST_GAIN:
        return True
    letters = values[97:123] + values[65:91]
    rest = values[:128].sum() - letters.sum()
    return gain < between(RANDOM_GAIN, len(raw)) and bits(np.append(letters, [rest, *values[128:]])) >= RANDOM_BITS


class Judge:
    def __init__(self):
        import zstandard

        self.size = lambda raw, c=zstandard.ZstdCompressor(level=LEVEL): len(c.compress(raw))

    def fits(self, chunk: bytes) -> bool:
        size = self.size(chunk)
        return (between(FLOOR, len(chunk)) <= len(chunk) / size <= top_of(CHUNK_TOPS, len(chunk))
                and not random_letters(chunk, size))

    def compression(self, raw: bytes) -> tuple[float | None, float, bool]:
        """(ratio of the whole, share of bytes in bad chunks, inside the bands)."""
        if not raw:
            return None, 0.0, True
        ratio = len(raw) / self.size(raw)
        bad = done = 0
        for at in range(0, max(1, len(raw) - CHUNK_STEP), CHUNK_STEP):
            chunk = raw[at:at + CHUNK_BYTES]
            if not self.fits(chunk):
                bad += at + len(chunk) - max(at, done)
                done = at + len(chunk)
        share = bad / len(raw)
        inside = between(FLOOR, len(raw)) <= ratio <= top_of(DOCUMENT_TOPS, len(raw))
        return ratio, share, inside and share <= BAD_CHUNK_SHARE

    def row(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.split()  # of bytes: at ASCII white space only
        letters = np.frombuffer(raw.translate(None, WHITE), np.uint8)
        lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
        repeated = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
        ratio, share, fine = self.compression(raw)
        return (len(words), int(((letters & 0xC0) != 0x80).sum()), len(raw) - len(raw.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)), repeated, ratio, share, failed, fine and not failed)


def _columns(texts: list[str | None], judge: Judge, names: list[str]) -> dict:
    return dict(zip(names, zip(*map(judge.row, texts))))


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` plus the base figures, both compression figures and the verdict.

    A null text has no words and fails like an empty one; repeated rows are judged each;
    an empty table gives no rows; other columns are ignored whatever their names."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def make():
        judge = Judge()
        return lambda texts: _columns(texts, judge, names)

    return map_text(docs, [*keep, "text"], SCHEMA, make)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept.

    Null, empty and very short texts go; texts of any length are judged whole; repeated rows stay or go together; an
    empty table gives no rows. Columns of any name pass unchanged."""
    verdict = unused("kept", docs.columns)

    def make():
        judge = Judge()
        return lambda texts: {verdict: pa.array([judge.row(t)[-1] for t in texts])}

    out = map_text(docs, docs.columns, f"{verdict} boolean", make, keep_text=True)
    return out.where(F.col(verdict)).select(*quoted(docs.columns))
