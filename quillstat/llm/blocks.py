"""Large groups cut into pairs of slices, so that comparing within a group never meets in one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import cpu_partitions, written

#: Names of the columns that ``paired_slices`` adds.
LOW, HIGH, OWN = "slice_low", "slice_high", "slice_own"
#: A list of large groups up to this number of rows (a key and an int each) is broadcast.
BROADCAST_GROUPS = 100_000


def paired_slices(rows: DataFrame, key: str, salt: Column, limit: int) -> DataFrame:
    """``rows`` plus (slice_low, slice_high, slice_own). A group of ``key`` with at most ``limit``
    rows stays whole, at (0, 0) and of slice 0. A larger one is dealt by ``salt`` to
    S = ceil(rows / limit) slices, and each row stands at all S pairs that hold its own slice:
    any two rows of a group share exactly one pair, or, if they are of one slice s, the pair
    (s, s) beside others."""
    large = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > limit)
                    .select(key, F.ceil(F.col("members") / limit).cast("int").alias("slices")), "large-groups")
    n = large.count()
    if not n:
        return rows.select("*", *[F.lit(0).alias(c) for c in (LOW, HIGH, OWN)])
    marked = rows.join(F.broadcast(large) if n <= BROADCAST_GROUPS else large, key, "left")
    marked = marked.withColumn("slices", F.coalesce("slices", F.lit(1)))
    marked = marked.withColumn(OWN, F.pmod(F.xxhash64(salt, F.lit("slice")), F.col("slices")).cast("int"))
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    out = marked.select("*", F.explode(others).alias("other"))
    return out.select(*rows.columns, F.least(OWN, "other").alias(LOW), F.greatest(OWN, "other").alias(HIGH), OWN)


def dealt(rows: DataFrame, key: str, *order) -> DataFrame:
    """``rows`` of ``paired_slices`` with each (key, pair) whole in one partition, in ``order``."""
    return rows.repartition(cpu_partitions(rows), key, LOW, HIGH).sortWithinPartitions(key, LOW, HIGH, *order)


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The rows of sorted batches, group by group of their first ``width`` columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for _, group in groupby(rows, lambda r: r[:width]):
        yield list(group)


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches again, cut where a group of the first ``width`` columns ends: tables of whole
    groups, each with the row numbers at which its groups begin, and its number of rows."""
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in table.columns[:width]:
            values = c.to_numpy()
            new |= values[1:] != values[:-1]
        return np.flatnonzero(new) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = [[b.column(i)[r].as_py() for i in range(width)] for b, r in ((held[0], 0), (batch, batch.num_rows - 1))]
        if ends[0] == ends[1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = begins(table)
        last = int(cuts[-1])
        yield table.slice(0, last), np.concatenate(([0], cuts))
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate(([0], begins(table), [table.num_rows]))
