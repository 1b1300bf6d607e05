"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a vocabulary span a lattice over a text. Forward filtering sums the weights of
all ways to reach each position; backward sampling draws, from the end, the piece that ends
at the present position with its share of that sum. The draw at a position depends only on
the row's key, the seed and the position, so a row gets the same pieces wherever and
whenever it is encoded.

No piece holds a space after another sign, so the lattice falls apart into blocks (spaces and
the signs up to the next space). Forward sums are worked out once for each distinct block of
a batch; the draws of all its occurrences are one numpy search.

Weights: a unigram model's pieces weigh exp(alpha * score). A BPE model's scores are merge
ranks, not log-probabilities; its pieces weigh (rank + 2) ** -alpha (Zipf's law). A sign
without a piece, the space sign U+2581 in a text among them, is spelled in byte pieces. No space
is added, dropped or normalised: decoding gives the text back.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstat.llm.common import slices

SPACE_SIGN = "▁"
#: Text bytes encoded together: the lattice of a batch takes some hundred bytes for each.
BATCH_BYTES = 3 << 19
BLOCK = re.compile(r" *[^ ]+| +")
#: Blocks of more signs are cut where no piece goes across (shorter ones are quick as they are).
LONG_BLOCK = 64
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a row's key and a position (a counter-based generator)."""
    h = keys + (positions.astype(np.uint64) + np.uint64(1)) * GOLDEN
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    # 24 bits: added to a node's number, they must not round up to the next node
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(40)).astype(np.float64) * 2.0 ** -24


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        bpe = model.trainer_spec.model_type == 2
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            text = p.piece.replace(SPACE_SIGN, " ")
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif p.type in (NORMAL, USER_DEFINED):
                rank = min(-p.score, float(len(model.pieces)))
                self.weight[text] = (i, (max(rank, 0.0) + 2.0) ** -alpha if bpe else float(np.exp(alpha * p.score)))
                self.surface.append(text.encode())
            else:
                self.surface.append(b"")
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary needs byte pieces to be lossless")
        if any(" " in s.lstrip(" ") for s in self.weight):
            raise ValueError("pieces with a space inside are not supported")
        self.least = min(w for _, w in self.weight.values())
        self._trie()
        #: numbers from len(surface) on stand for signs spelled in bytes
        self.spelled: dict[int, int] = {}
        self.spelling: list[list[int]] = []

    def _trie(self) -> None:
        """All pieces' prefixes: a hash table from keys (prefix number, next sign) to the prefix each leads to, and
        the piece (or -1) and log weight that a prefix is."""
        numbers, links = {"": 0}, []
        for piece in self.weight:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in numbers:
                    numbers[piece[:n]] = len(numbers)
                    links.append((numbers[piece[:n - 1]] << 21 | ord(piece[n - 1]), numbers[piece[:n]]))
        bits = (4 * len(links)).bit_length()  # at most a quarter of the slots are taken
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        keys, child = (np.array(x, np.int64) for x in zip(*links))
        for slot, key, to in zip(self.slot(keys).tolist(), keys.tolist(), child.tolist()):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.slots
            self.keys[slot], self.child[slot] = key, to
        self.piece_at = np.full(len(numbers), -1, np.int64)
        self.log_weight = np.full(len(self.surface), -np.inf)
        for piece, (number, weight) in self.weight.items():
            self.piece_at[numbers[piece]] = number
            self.log_weight[number] = np.log(weight)

        inside = {ord(p[i]) << 21 | ord(p[i + 1]) for p in self.weight for i in range(len(p) - 1)}
        #: neighbouring signs that some piece holds together, as sorted numbers
        self.together = np.array(sorted(inside), np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * GOLDEN >> self.shift).view(np.int64)

    def linked(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no piece goes on like that."""
        slot = self.slot(keys)
        found = self.keys[slot]
        go = np.flatnonzero((found != keys) & (found >= 0))  # the slot is another key's: try the next one
        while len(go):
            slot[go] = slot[go] + 1 & self.slots
            found[go] = now = self.keys[slot[go]]
            go = go[(now != keys[go]) & (now >= 0)]
        return np.where(found == keys, slot, -1)

    def cut(self, block: str) -> list[str]:
        """A long block in parts: between signs that no piece holds together every segmentation has a
        border, so the parts' lattices are the block's."""
        if len(block) <= LONG_BLOCK:
            return [block]
        codes = np.frombuffer(block.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.together, pairs), len(self.together) - 1)
        borders = [0, *(np.flatnonzero(self.together[at] != pairs) + 1).tolist(), len(block)] if len(self.together) else list(range(len(block) + 1))
        return [block[a:b] for a, b in zip(borders, borders[1:])]

    def in_bytes(self, sign: int) -> int:
        if sign not in self.spelled:
            self.spelled[sign] = len(self.surface) + len(self.spelling)
            self.spelling.append([self.bytes[b] for b in chr(sign).encode()])
        return self.spelled[sign]

    def edges(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in all blocks: (block, first sign, number of signs, piece number). Block b is
        ``codes[start[b]:start[b] + size[b]]``. A sign without a piece of its own is one edge in bytes."""
        block = np.repeat(np.arange(len(size), dtype=np.int32), size)
        room = (np.repeat(start + size, size) - np.arange(len(codes))).astype(np.int32)
        at, state, out = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int64), []
        n = 0
        while len(at):
            n += 1
            key = state << 21 | codes[at + n - 1]
            link = self.linked(key)
            there = link >= 0
            state = self.child[link[there]]
            piece = self.piece_at[state]
            if n == 1:
                alone = np.full(len(at), -1)
                alone[there] = piece
                bare = np.flatnonzero(alone < 0)
                signs, where = np.unique(codes[bare], return_inverse=True)
                spelled = np.array([self.in_bytes(c) for c in signs.tolist()], np.int64)
                out.append((bare.astype(np.int32), np.ones(len(bare), np.int32), spelled[where].astype(np.int32)))
            at = at[there]
            real = piece >= 0
            out.append((at[real], np.full(int(real.sum()), n, np.int32), piece[real].astype(np.int32)))
            go = room[at] > n
            at, state = at[go], state[go]
        at, length, piece = map(np.concatenate, zip(*out))
        own = block[at]
        return own, (at - start[own]).astype(np.int32), length, piece

    def filtered(self, blocks: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of distinct blocks, longest first. Node (j, b), the place after j signs of
        block b, has the number ``first[j] + b``. Returns ``first``, each node's first edge and, for all edges
        in the order of the node they end at, node + cumulated share, piece number and number of signs."""
        codes = np.frombuffer("".join(blocks).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        block, begin, length, piece = self.edges(codes, np.cumsum(size) - size, size)
        deep = int(size[0])
        at_least = len(size) - np.searchsorted(size[::-1], np.arange(deep + 1))  # blocks with j signs or more
        first = np.cumsum(at_least) - at_least
        node = first[begin + length] + block
        order = np.argsort(node, kind="stable")
        node, source, piece, length = node[order], (first[begin] + block)[order], piece[order], length[order]
        del block, begin, order
        spelled = np.array([len(s) for s in self.spelling] or [0], np.float64)
        weight = np.where(piece < len(self.surface), self.log_weight[np.minimum(piece, len(self.surface) - 1)],
                          np.log(self.least) * spelled[np.clip(piece - len(self.surface), 0, len(spelled) - 1)])
        total = np.zeros(int(at_least.sum()))
        cums = np.empty(len(node))
        cut = np.searchsorted(node, np.append(first, len(total)))
        for j in range(1, deep + 1):
            a, b = cut[j], cut[j + 1]
            value = weight[a:b] + total[source[a:b]]
            own = node[a:b] - first[j]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
            top = np.maximum.reduceat(value, heads)
            part = np.exp(value - top[own])
            whole = np.add.reduceat(part, heads)
            total[first[j]:first[j] + at_least[j]] = top + np.log(whole)
            run = np.cumsum(part)
            run -= (run[heads] - part[heads])[own]
            share = run / whole[own]
            share[np.append(heads[1:], b - a) - 1] = 1.0
            cums[a:b] = node[a:b] + np.minimum(share, 1.0)
        count = np.bincount(node, minlength=len(total))
        return first, np.cumsum(count) - count, cums, piece, length

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        found = [BLOCK.findall(t) if t else [] for t in texts]
        for i, f in enumerate(found):
            if max(map(len, f), default=0) > LONG_BLOCK:
                found[i] = [part for b in f for part in self.cut(b)]
        blocks = pa.array(list(chain.from_iterable(found)), pa.large_utf8())
        if not len(blocks):
            return [np.empty(0, "<u4")] * len(texts)
        coded = blocks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ranked = sorted(range(len(distinct)), key=lambda i: -len(distinct[i]))
        rank = np.empty(len(distinct), np.int64)
        rank[ranked] = np.arange(len(distinct))
        first, edge, cums, piece, length = self.filtered([distinct[i] for i in ranked])
        index = rank[coded.indices.to_numpy()]
        left = pc.utf8_length(blocks).to_numpy().astype(np.int64)
        of_text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        at = np.cumsum(left)  # ends in the batch
        text_sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        origin = (np.cumsum(text_sizes) - text_sizes)[of_text]
        key, block = keys[of_text], index
        drawn = np.full(int(text_sizes.sum()) + 1, -1, np.int64)
        while len(left):
            # every node's cumulated shares end at the node's number plus 1
            node = first[left] + block
            drawn_share, pick = node + uniform(key, at - origin), edge[node]
            more = np.flatnonzero(cums[pick] <= drawn_share)
            while len(more):
                pick[more] += 1
                more = more[cums[pick[more]] <= drawn_share[more]]
            drawn[at] = piece[pick]
            left, at = left - length[pick], at - length[pick]
            go = left > 0
            left, at, block, key, origin = left[go], at[go], block[go], key[go], origin[go]
        placed = np.flatnonzero(drawn >= 0)
        number = drawn[placed]
        spread = np.array([1] * len(self.surface) + [len(s) for s in self.spelling], np.int64)
        flat = np.array(list(range(len(self.surface))) + [x for s in self.spelling for x in s], np.int64)
        start = np.cumsum(spread) - spread
        count = spread[number]
        ends = np.cumsum(count)
        ids = flat[np.repeat(start[number] - (ends - count), count) + np.arange(count.sum())].astype("<u4")
        borders = np.append(0, ends)[np.searchsorted(placed, np.append(0, np.cumsum(text_sizes)), "right")]
        return [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode()


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    return Vocabulary(path, alpha)


def encode(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, text and ids (binary, little-endian unsigned 32 bit) of every row.

    A null text has no ids; rows with the same key and text get the same ids; a null key is a key
    like any other; other columns are ignored whatever their names; an empty table gives no rows. A text of any
    length is encoded whole."""
    rows = docs.select(F.col(key), F.xxhash64(F.lit(seed).cast("long"), F.col(key)).alias("_row_key"), "text")
    schema = rows.select(F.col(key), "text", F.lit(b"").alias("ids")).schema

    def run(batches):
        words = vocabulary(path, alpha)
        for part in slices(batches, most=BATCH_BYTES):
            if len(words.spelling) > 100_000:  # a memory of signs, not of texts
                words.spelled, words.spelling = {}, []
            keys = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            ids = words.encode(part.column(2).to_pylist(), keys)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([i.tobytes() for i in ids], pa.binary())],
                                             names=[key, "text", "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """``encoded`` (ids, any other columns) plus the decoded text (null ids: null). Columns of any name pass, one
    that is called ``out`` already is replaced; an empty table gives no rows."""
    names = encoded.columns
    ids_at, kept = f"c{names.index('ids')}", [i for i, c in enumerate(names) if c.lower() != out.lower()]
    schema = StructType([encoded.schema.fields[i] for i in kept] + [StructField(out, StringType())])
    placed = encoded.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow takes no names with dots

    def run(batches):
        words = vocabulary(path)
        for part in slices(batches, ids_at, BATCH_BYTES):
            ids = part.column(part.schema.get_field_index(ids_at)).to_pylist()
            texts = [None if i is None else words.decode(np.frombuffer(i, "<u4")) for i in ids]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(texts, pa.string())], names=schema.names)

    return placed.mapInArrow(run, schema)
