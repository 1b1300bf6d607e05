"""Hard negatives by spanning-tree bounds over the anchors.

Scores are integer inner products. Anchors are dealt to blocks of similar ones, and each block's anchors are
joined by a minimum spanning tree. A candidate's score at the root is worked out; at a child it lies within
the parent's score plus or minus edge length times the candidate's norm (Cauchy-Schwarz), and where
the parent's score is itself only bounded, the bounds add up. Only candidates whose bounds overlap the window that the
anchor still asks for are scored again, exactly.

Two passes over all rows: the best rows of the anchor's label (window: from the worst of the best so
far), then, for each of these positives, the best rows of other labels within a share of the positive's score.
Rows are packed into chunks; a task holds one block of anchors and goes through its share of the chunks,
keeping the best of each window, so nothing else is held or handed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import cpu_partitions, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negatives score between these percentages of the positive's score, both included.
LOW_PERCENT, HIGH_PERCENT = 30, 90
BLOCK_ANCHORS = 256
CHUNK_ROWS = 1024
#: Rows that one task compares with a block of anchors.
SHARE_ROWS = 1 << 16
#: A level of the tree is scored by one matrix product where at least this share of it is asked for.
DENSE = 0.25


def participants(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, embedding as doubles) of the rows that take part."""
    v = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                      F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("embedding"))


def padded(column: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers as int32, shorter vectors filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= 1 << 31:
        raise ValueError("components beyond 2^31 after scaling: their scores may not fit a long")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents (the root's is itself), edge lengths and depths of a minimum spanning tree from row 0."""
    x, n = vectors.astype(np.float64), len(vectors)
    parent, depth = np.zeros(n, np.int32), np.zeros(n, np.int32)
    length, left = np.linalg.norm(x - x[0], axis=1), np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        at = int(np.argmin(np.where(left, length, np.inf)))
        left[at] = False
        depth[at] = depth[parent[at]] + 1
        far = np.linalg.norm(x - x[at], axis=1)
        nearer = left & (far < length)
        length[nearer], parent[nearer] = far[nearer], at
    length[0] = 0
    return parent, length, depth


def pack(batch: pa.RecordBatch, number: int, name: str, tree: bool) -> pa.RecordBatch:
    """(vec_id, label, embedding) as one row: number, dims, ids, labels, vectors and, for anchors, their tree."""
    vectors = padded(batch.column(2))
    parts = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), vectors]
    if tree:
        parts.extend(spanning_tree(vectors))
    columns = [pa.array([number], pa.int64()), pa.array([vectors.shape[1]], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()]) for p in parts)]
    return pa.RecordBatch.from_arrays(columns, names=[name, "dims", "ids", "labels", "vectors", *(["parent", "length", "depth"] if tree else [])])


def packed(rows: DataFrame, size: int | None, name: str, tree: bool = False) -> DataFrame:
    """Each partition's rows in packs of at most ``size``, or whole, numbered as the partition."""
    def run(batches):
        from pyspark import TaskContext

        part_no = TaskContext.get().partitionId()
        held, n, number = [], 0, part_no if size is None else part_no << 32

        def out(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            return pack(table.to_batches()[0], number, name, tree)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, batch.num_rows if size is None else size - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == size:
                    yield out(held)
                    held, n, number = [], 0, number + 1
        if n:
            yield out(held)

    extra = ", parent binary, length binary, depth binary" if tree else ""
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"{name} long, dims int, ids binary, labels binary, vectors binary{extra}")


def likeness(vector: str = "embedding") -> Column:
    """Orders vectors so that similar ones stand close: the signs of the first 32 components."""
    return F.array_join(F.transform(F.slice(vector, 1, 32), lambda x: F.when(x < 0, F.lit("0")).otherwise("1")), "")


def anchor_blocks(anchors: DataFrame, size: int = BLOCK_ANCHORS) -> tuple[DataFrame, int]:
    """The distinct ``anchors`` in blocks of about ``size`` similar ones, each with its tree; and the blocks' number n
    (their numbers lie below it, some may be missing)."""
    distinct = written(anchors.dropDuplicates(), "anchors")
    n = max(1, -(-distinct.count() // size))
    # range partitions are even: the id splits equal signs
    ordered = distinct.repartitionByRange(n, likeness(), F.col("vec_id")).sortWithinPartitions(likeness(), "vec_id")
    return written(packed(ordered, None, "block", True), "anchor-blocks"), n


class Block:
    """Anchors with their tree, their windows and the best rows found in each window."""

    def __init__(self, row: dict, wanted: int, same_label: bool):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(self.ids), row["dims"])
        self.parent, self.depth = (np.frombuffer(row[c], np.int32) for c in ("parent", "depth"))
        self.length = np.frombuffer(row["length"], np.float64) * (1 + 1e-9)
        self.wanted, self.same_label = wanted, same_label
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)]
        self.scored = self.bounded = 0
        # windows: one without limits for each anchor, or those of its positives
        if same_label:
            self.windows = [(a, 0, None, None) for a in range(len(self.ids))]
        else:
            self.windows = [(a, w, low, high) for a, w, low, high in (row["windows"] or []) if low <= high]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.windows]
        self.of_anchor: dict[int, list[int]] = {}
        for i, (a, *_) in enumerate(self.windows):
            self.of_anchor.setdefault(a, []).append(i)

    def floor(self, i: int) -> float:
        """The least score that can still enter window i."""
        low, held = self.windows[i][2], self.best[i][0]
        worst = held[-1] if len(held) == self.wanted else None
        return max((x for x in (low, worst) if x is not None), default=-np.inf)

    def scores(self, anchors: np.ndarray, rows: np.ndarray, exact_floats: bool) -> np.ndarray:
        kind = np.float64 if exact_floats else np.int64
        dims = min(self.vectors.shape[1], rows.shape[1])
        return self.vectors[anchors, :dims].astype(kind) @ rows[:, :dims].astype(kind).T

    def take(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Go through a chunk of candidates."""
        norms = np.linalg.norm(rows.astype(np.float64), axis=1)
        largest = float(norms.max(initial=0)) * float(np.linalg.norm(self.vectors.astype(np.float64), axis=1).max(initial=0))
        if largest >= 2.0 ** 55:
            raise ValueError("scores may not fit a long")
        floats, dims = largest < 2.0 ** 52, min(self.vectors.shape[1], rows.shape[1])
        low, high = np.full(len(self.ids), np.inf), np.full(len(self.ids), -np.inf)
        for a, windows in self.of_anchor.items():
            low[a] = min(self.floor(i) for i in windows)
            high[a] = max(np.inf if self.windows[i][3] is None else self.windows[i][3] for i in windows)
        least = np.empty((len(self.ids), len(ids)))
        most = np.empty_like(least)
        for depth, level in enumerate(self.levels):
            reach = self.length[level][:, None] * norms
            up = self.parent[level]
            bounds = (least[up] - reach, most[up] + reach) if depth else (np.full((1, len(ids)), -np.inf), np.full((1, len(ids)), np.inf))
            asked = (bounds[1] >= low[level][:, None]) & (bounds[0] <= high[level][:, None])
            other = labels != self.labels[level][:, None]
            asked &= (~other & (ids != self.ids[level][:, None])) if self.same_label else other
            i, j = np.nonzero(asked)
            if not depth or len(i) >= DENSE * asked.size:
                exact = self.scores(level, rows, floats)
                least[level] = most[level] = exact
                values = exact[i, j]
                self.scored += exact.size
            else:
                values = np.einsum("ij,ij->i", self.vectors[level[i], :dims].astype(np.float64 if floats else np.int64),
                                   rows[j, :dims].astype(np.float64 if floats else np.int64))
                bounds[0][i, j] = bounds[1][i, j] = values
                least[level], most[level] = bounds
                self.scored += len(i)
            self.bounded += asked.size
            cuts = np.searchsorted(i, np.arange(len(level) + 1))
            for a, start, end in zip(level.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                if start < end and a in self.of_anchor:
                    self.enter(a, values[start:end].astype(np.int64), ids[j[start:end]])

    def enter(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for i in self.of_anchor[anchor]:
            high = self.windows[i][3]
            good = scores >= self.floor(i)
            if high is not None:
                good &= scores <= high
            if good.any():
                s, k = np.concatenate((self.best[i][0], scores[good])), np.concatenate((self.best[i][1], ids[good]))
                order = np.lexsort((k, -s))[:self.wanted]
                self.best[i] = s[order], k[order]

    def found(self) -> list[tuple]:
        """(anchor's place, its id, window, score, row) of the best rows."""
        return [(a, int(self.ids[a]), w, int(s), int(k)) for (a, w, _, _), (ss, ks) in zip(self.windows, self.best) for s, k in zip(ss, ks)]


def best_rows(blocks: DataFrame, n: int, chunks: DataFrame, shares: int, wanted: int, same_label: bool) -> DataFrame:
    """(block, slot, anchor_id, win, place, score, row_id): the best ``wanted`` rows of every window, place from 1."""
    shape = "block long, share int, kind int, dims int, ids binary, labels binary, vectors binary, parent binary, length binary, depth binary, " \
            "windows array<struct<slot:int,win:int,low:long,high:long>>"
    names = [c.split()[0] for c in shape.split(", ")]
    types = dict(zip(names, [c.split()[1] for c in shape.split(", ")]))
    if "windows" not in blocks.columns:
        blocks = blocks.withColumn("windows", F.lit(None).cast(types["windows"]))
    each_share = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("kind", F.lit(0))
    # the stated anchors against all rows, in blocks: every chunk goes to every block, by one share of it
    each_block = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "share", F.pmod(F.xxhash64("chunk"), F.lit(shares)).cast("int")).withColumn("kind", F.lit(1))
    for c in ("parent", "length", "depth", "windows"):
        each_block = each_block.withColumn(c, F.lit(None).cast(types[c]))
    both = each_share.select(*[F.col(c).cast(types[c]) for c in names]).unionByName(each_block.select(*[F.col(c).cast(types[c]) for c in names]))
    parts = max(1, min(n * shares, cpu_partitions(both) * 4))
    both = both.repartition(parts, "block", "share").sortWithinPartitions("block", "share", "kind")

    def run(batches):
        block, number = None, None

        def out():
            rows = block.found()
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(
                columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())))], names=["block", "slot", "anchor_id", "win", "score", "row_id"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if not row["kind"]:
                    if block is not None:
                        yield out()
                    row["windows"] = [tuple(w.values()) for w in row["windows"] or []]
                    block, number = Block(row, wanted, same_label), row["block"]
                elif block is not None and block.windows:
                    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                    block.take(ids, labels, np.frombuffer(row["vectors"], np.int32).reshape(len(ids), row["dims"]))
        if block is not None:
            yield out()

    found = both.mapInArrow(run, "block long, slot int, anchor_id long, win int, score long, row_id long")
    order = Window.partitionBy("block", "slot", "win").orderBy(F.desc("score"), "row_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, block_anchors: int = BLOCK_ANCHORS,
                   chunk_rows: int = CHUNK_ROWS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the inner product (a shorter vector is filled up with
    zeros). Positives of an anchor: the best ``positives`` rows of its label with another id. Negatives of a
    positive: the best ``negatives`` rows of other labels whose score is between ``low_percent`` and ``high_percent``
    of the positive's. Higher scores first, ties by the smaller vec_id. A positive without negatives has no rows.

    Rows with a null id, label or vector, or a null or non-finite component take no part. A repeated row counts
    as often as it stands as a positive or negative, and once as an anchor. Other columns are not read; an empty
    table gives no rows. Scores that might not fit a long raise an error."""
    rows = participants(vectors, scale)
    blocks, n = anchor_blocks(rows.where(is_anchor), block_anchors)
    chunks = written(packed(rows, chunk_rows, "chunk"), "chunks")
    n_rows = chunks.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    shares = max(1, int(-(-n_rows // share_rows)), min(-(-cpu_partitions(rows) // n), int(-(-n_rows // chunk_rows))))
    near = written(best_rows(blocks, n, chunks, shares, positives, True), "positives")
    # whole scores s with low <= 100 * s / p <= high
    floor = lambda percent: f"(({percent}) * score - pmod(({percent}) * score, 100)) div 100"
    limits = near.select("block", F.struct("slot", F.expr("int(place - 1)").alias("win"), F.expr(f"-({floor(-int(low_percent))})").alias("low"),
                                           F.expr(floor(int(high_percent))).alias("high")).alias("w"))
    windows = limits.groupBy("block").agg(F.collect_list("w").alias("windows"))  # at most positives x block_anchors
    far = best_rows(blocks.join(windows, "block"), n, chunks, shares, negatives, False)
    named = near.select("block", "slot", (F.col("place") - 1).cast("int").alias("win"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["block", "slot", "win"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
