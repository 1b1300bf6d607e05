"""Exact membership of a column's value in a driver-side list, inside the projection.

A short list is an ``IN``. A longer one becomes two folded literals: the values in order of
their CRC-32 bucket, and where each bucket starts; a lookup hashes, slices its bucket (a few
values) and compares. No join and no exchange, whatever the rows hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.text import let

#: Longest list written as IN (longer ones cost more to plan than the buckets do).
IN_VALUES = 500
#: Bytes of values up to which a table may become a literal of the plan.
LITERAL_BYTES = 2 << 20
_SEPARATORS = ["\x1f", "\x1e", "\x1d", "\x1c", "\x01", "\x02"]


def bounded_values(table: DataFrame, value: str, max_bytes: int = LITERAL_BYTES) -> bool:
    """Whether the non-null values of a string column take at most ``max_bytes`` (one aggregate)."""
    n = table.agg(F.sum(F.octet_length(value) + 1)).first()[0]
    return (n or 0) <= max_bytes


def few_rows(table: DataFrame, value: str, max_bytes: int = LITERAL_BYTES) -> list | None:
    """All rows of a table whose ``value`` column takes at most ``max_bytes``, else None. A short table is one job."""
    if max_bytes <= 0:
        return None
    rows = table.limit(IN_VALUES + 1).collect()
    if len(rows) <= IN_VALUES:
        return rows if sum(len((r[value] or "").encode()) + 1 for r in rows) <= max_bytes else None
    return table.collect() if bounded_values(table, value, max_bytes) else None


def member(value: Column, values: Sequence[str]) -> Column:
    """True where ``value`` is one of ``values``, null where it is null (False for no values)."""
    if not values:
        return F.lit(False)
    if len(values) <= IN_VALUES:
        return value.isin(list(values))
    sep = next((s for s in _SEPARATORS if not any(s in v for v in values)), None)
    if sep is None:
        return value.isin(list(values))
    buckets = max(1, len(values) // 4)
    held: list[list[str]] = [[] for _ in range(buckets)]
    for v in sorted(set(values)):
        held[zlib.crc32(v.encode()) % buckets].append(v)
    starts, at = [], 0
    for b in held:
        starts.append(at)
        at += len(b)
    starts.append(at)
    names = F.split(F.lit(sep.join(v for b in held for v in b)), sep)
    edges = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<int>")

    def found(v: Column) -> Column:
        def in_bucket(b: Column) -> Column:
            start, end = F.element_at(edges, b + 1), F.element_at(edges, b + 2)
            return F.array_contains(F.slice(names, start + 1, end - start), v)
        return let(F.pmod(F.crc32(v.cast("binary")), F.lit(buckets)).cast("int"), in_bucket)

    return F.when(value.isNotNull(), let(value, found))
