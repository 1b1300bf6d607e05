"""Best-fit packing of documents into sequences of a fixed length by local search.

1. Every document becomes ids (its end id included); only longer ones are cut into pieces
   of the full length, of which the first may be shorter.
2. The pieces are written once to the shared folder, and dealt evenly to packing groups by
   their row numbers, whatever their ids are. Groups have a bounded number of pieces; more
   documents make more groups.
3. A group starts from best-fit decreasing and goes on by local search: underfull bins
   exchange one-for-one, two-for-one or move documents between all pairs of them. Every step raises
   the sum of squared fills, so the search ends; bins that become empty are gone. It stops
   early when the bins reach the lower bound, or after ``STEPS_A_PIECE`` steps a piece.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.bpe import coder
from quillstat.llm.common import FEW_BYTES_AT_ONCE, slices, unused, written

#: Pieces of a packing group (on average): bounds a task's memory.
GROUP_PIECES = 16_384


#: Steps of the search for each piece of its group (it takes about one for two pieces before it ends by itself).
STEPS_A_PIECE = 2
#: Bins of more items take part in pairs of items no longer: with so many small ones, single items fit.
PAIR_ITEMS = 8


#: Stale entries that the search's index may gather, besides twice its live ones.
STALE_ENTRIES = 50_000


def _low_bit(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: each item goes where the least room is left."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + _low_bit(fits)
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


class Search:
    """Local search over all underfull bins.

    The bins are gone through from the fullest on. Each takes what leaves it least room: an item or a pair of
    another bin, for nothing (a move), for one of its own items (one-for-one, two-for-one) or for two of them
    (one-for-two). It takes from a bin that is less full than it becomes itself, so every step raises the sum of
    squared fills. A bin that nothing improves is tried again in the next round, when others have
    changed; the search ends with a round without steps, at the lower bound, or after ``steps`` steps.

    ``single[s]`` and ``double[s]`` hold the items and pairs of size s in underfull bins, those of the least
    filled bin first. Entries carry the bin's version and are dropped when they turn out stale."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int, steps: int | None = None):
        self.sizes, self.bins, self.capacity = sizes, [list(b) for b in bins], capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.steps = STEPS_A_PIECE * len(sizes) if steps is None else steps
        self.taken = 0
        self.index()

    def index(self) -> None:
        """Index all bins anew, without the stale entries that have gathered."""
        self.single: list[list] = [[] for _ in range(self.capacity + 1)]
        self.double: list[list] = [[] for _ in range(self.capacity + 1)]
        self.singles = self.doubles = 0  # sizes that have entries, as bits
        self.entries = 0
        for b in range(len(self.bins)):
            self.enter(b)
        self.most_entries = 3 * self.entries + STALE_ENTRIES

    def enter(self, b: int) -> None:
        """Index a bin anew after a change."""
        self.version[b] += 1
        fill, items, version = self.fill[b], self.bins[b], self.version[b]
        if fill == self.capacity:
            return
        self.entries += len(items)
        for i in items:
            heapq.heappush(self.single[self.sizes[i]], (fill, b, version, i, -1))
            self.singles |= 1 << self.sizes[i]
        if len(items) <= PAIR_ITEMS:
            self.entries += len(items) * (len(items) - 1) // 2
            for i, j in combinations(items, 2):
                size = self.sizes[i] + self.sizes[j]
                heapq.heappush(self.double[size], (fill, b, version, i, j))
                self.doubles |= 1 << size

    def leave(self, b: int) -> None:
        self.version[b] += 1

    def largest(self, pairs: bool, low: int, high: int, below: int) -> tuple[int, tuple] | None:
        """The largest item (or pair) over ``low`` up to ``high`` of a bin whose fill is under
        ``below`` plus its size."""
        heaps, mask = (self.double, self.doubles) if pairs else (self.single, self.singles)
        mask &= (1 << (high + 1)) - 1
        mask = mask >> (low + 1) << (low + 1)
        while mask:
            size = mask.bit_length() - 1
            held = heaps[size]
            while held and self.version[held[0][1]] != held[0][2]:
                heapq.heappop(held)
            if held:
                if held[0][0] < below + size:
                    return size, held[0]
            elif pairs:
                self.doubles &= ~(1 << size)
            else:
                self.singles &= ~(1 << size)
            mask ^= 1 << size
        return None

    def improvement(self, b: int) -> tuple[tuple[int, ...], tuple] | None:
        """(items to give, entry to take) that leaves bin b least room; b itself is not indexed."""
        fill, items = self.fill[b], self.bins[b]
        room = self.capacity - fill
        gain, best, seen = 0, None, set()
        offers = [(), *((i,) for i in items), *(combinations(items, 2) if len(items) <= PAIR_ITEMS else ())]
        for out in offers:
            gone = sum(self.sizes[i] for i in out)
            if (len(out), gone) in seen:
                continue
            seen.add((len(out), gone))
            for pairs in (False, True)[:1 if len(out) == 2 else 2]:
                found = self.largest(pairs, gone + gain, gone + room, fill - gone)
                if found:
                    gain, best = found[0] - gone, (out, found[1])
                    if gain == room:
                        return best
        return best

    def exchange(self, b: int, out: tuple[int, ...], entry: tuple) -> int:
        """Take the step; returns the other bin."""
        _, other, _, *come = entry
        come = [i for i in come if i >= 0]
        for i in out:
            self.bins[b].remove(i)
            self.bins[other].append(i)
        for i in come:
            self.bins[other].remove(i)
            self.bins[b].append(i)
        gain = sum(self.sizes[i] for i in come) - sum(self.sizes[i] for i in out)
        self.fill[b] += gain
        self.fill[other] -= gain
        self.enter(other)
        self.taken += 1
        return other

    def run(self) -> list[list[int]]:
        least = -(-sum(self.fill) // self.capacity)
        left, before = sum(map(bool, self.bins)), -1
        while left > least and before < self.taken < self.steps:
            before = self.taken
            for b in sorted((b for b, f in enumerate(self.fill) if f < self.capacity and self.bins[b]), key=lambda b: -self.fill[b]):
                if not self.bins[b]:
                    continue
                if self.entries > self.most_entries:
                    self.index()
                self.leave(b)
                while self.fill[b] < self.capacity and self.taken < self.steps:
                    found = self.improvement(b)
                    if not found:
                        break
                    left -= not self.bins[self.exchange(b, *found)]
                self.enter(b)
                if left <= least:
                    break
        return [b for b in self.bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place of every length; full ones get a bin of their own."""
    sizes = lengths.tolist()
    if sizes and (max(sizes) > capacity or min(sizes) < 0):
        raise ValueError(f"piece lengths must be between 0 and {capacity}")
    part = [i for i, s in enumerate(sizes) if s < capacity]
    held = [sizes[i] for i in part]
    bins = [[part[i] for i in b] for b in Search(held, best_fit_decreasing(held, capacity), capacity).run()]
    bins += [[i] for i, s in enumerate(sizes) if s == capacity]
    number, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            number[i], place[i] = b, at
            at += sizes[i]
    return number, place


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` (any columns, ``length`` from 0 to ``capacity``) plus sequence_id and offset.

    ``pieces`` should be a stored table: the row numbers that deal rows to groups must be the
    same if a task runs again. Ties and repeated rows are pieces like any other; columns that
    are already called sequence_id or offset are replaced."""
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.count()
    groups = max(1, -(-total // GROUP_PIECES))
    dealt_to = unused("_group", pieces.columns)
    dealt = pieces.withColumn(dealt_to, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def one(table: pa.Table) -> pa.Table:
        group = table.column(dealt_to)[0].as_py()
        number, place = pack_lengths(table.column(length).to_numpy(), capacity)
        return (table.drop_columns([dealt_to]).append_column("sequence_id", pa.array((group << 32) + number))
                .append_column("offset", pa.array(place)))

    return dealt.groupBy(dealt_to).applyInArrow(one, schema)


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for,
    ids (binary, little-endian unsigned 32 bit). A null text is empty (its end id alone)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        code = coder(vocabulary)
        for part in slices(batches, most=FEW_BYTES_AT_ONCE):
            flat, sizes = code.encode(part.column(1).to_pylist())
            ends = np.cumsum(sizes)
            flat = np.insert(flat, ends, np.array([end_id], code.dtype)).astype("<u4")
            sizes = sizes + 1
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = sizes - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            raw = [flat[a:a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())]
            made = {"doc_id": part.column(0).cast(pa.int64()).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                    "start": start, "length": length, "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64())}
            if with_ids:
                made["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(made)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and place of each (see ``cut`` and ``pack``).

    With ``with_ids`` the rows carry their ids, so that a sequence's tokens are its pieces' ids in
    order of ``offset``."""
    return pack(written(cut(docs, vocabulary, end_id, capacity, with_ids), "pieces"), capacity)
