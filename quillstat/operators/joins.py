"""Size-checked broadcast for dimension tables.

A dimension side is broadcast only when it is proven small: its rows are known at construction
(local rule tables), or one bounded pass counts its rows and bytes. Beyond either bound the join is
left to the planner (sort-merge, with AQE re-planning and skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 64 << 20


def counted_size(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """(rows, bytes as text) of at most ``max_rows + 1`` rows."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(16))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n, size or 0


def small_side(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, known_rows: int | None = None,
               max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    if known_rows is not None:
        return F.broadcast(df) if known_rows <= max_rows else df
    n, size = counted_size(df, max_rows)
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def collect_small(df: DataFrame, max_rows: int = 100_000) -> list:
    """Rows of a rule-sized table, refusing anything that is not provably small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"rule table has more than {max_rows} rows; refusing to ship it to tasks")
    return rows
