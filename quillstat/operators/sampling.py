"""Story selection: range/outlet filters, media-set membership, repeatable sample, paging.

Filters are plain column predicates on the story table, so on a parquet (or
``publish_month``-partitioned) story table Catalyst pushes them into the scan
and prunes partitions. A small sample is a top-k over a deterministic mix of the
story id (``TakeOrderedAndProject``: each task keeps k rows, the driver merges
k × tasks); a large one is cut at a key value that histograms find. Both are repeatable
and never sort the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.operators.joins import small_side

# FIXED VALUES: multiplicative mix for the repeatable sample order (Knuth's constant, 2^32)
MIX_MULT = 2654435761
MIX_MOD = 4294967296
MIX_HALF = 65536

#: Rows up to which a sample or a page is a top-k whose rows meet on the driver.
TOP_K = 10_000
#: Ranges that ids are cut into at a time, and rows besides the page's that end the cutting.
PAGE_RANGES = 256
PAGE_REST = 100_000


def story_scan(stories: DataFrame, start: str, end: str, media_ids: list[str] | None = None,
               closed: bool = False) -> DataFrame:
    """Stories with start <= publish_date < end (``closed=True``: both ends included, the
    source's bracket range) and, optionally, media_id in a list."""
    d = F.col("publish_date")
    cond = d.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) if closed else \
        (d >= F.lit(start).cast("timestamp")) & (d < F.lit(end).cast("timestamp"))
    if media_ids is not None:
        cond = cond & F.col("media_id").isin(list(media_ids))
    if "publish_month" in stories.columns:
        # redundant month bounds on the partition column: lets the scan prune partitions
        m = F.col("publish_month")
        cond = cond & (m >= F.date_format(F.lit(start).cast("timestamp"), "yyyy-MM")) & \
            (m <= F.date_format(F.lit(end).cast("timestamp"), "yyyy-MM"))
    return stories.where(cond)


def in_media_set(stories: DataFrame, media_sets: DataFrame, set_id: int) -> DataFrame:
    """Stories whose outlet belongs to a media set (left semi join, set side size-checked)."""
    members = media_sets.where(F.col("media_sets_id") == set_id).select("media_id")
    return stories.join(small_side(members), "media_id", "left_semi")


def mix_key(seed: int) -> Column:
    """The pseudo-random order's key, from 0 to below 2^32."""
    # (id * MIX_MULT + seed) mod 2^32, in 16-bit steps so that no id overflows a long
    half = MIX_HALF
    low = F.pmod(F.col("stories_id"), F.lit(MIX_MOD))
    high = (F.floor(low / half) * F.lit(MIX_MULT)) % F.lit(MIX_MOD)
    key = (high * half + (low % half) * F.lit(MIX_MULT) + F.lit(seed)) % F.lit(MIX_MOD)
    return key


def sample_stories(stories: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n stories in a repeatable pseudo-random order (ties broken by id)."""
    if n <= TOP_K:
        return stories.orderBy(mix_key(seed), F.col("stories_id")).limit(n)
    return sample_below_cut(stories, n, seed)


def sample_below_cut(stories: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The rows of ``sample_stories`` without a sort: two histograms of at most 65,537 counts find the
    key value at which the n-th row lies; rows below it are all taken, only that value's own rows are ordered."""
    keyed = stories.withColumn("_key", F.coalesce(mix_key(seed), F.lit(-1)))  # a null id comes first
    if n <= 0:
        return stories.where(F.lit(False))

    def cut(rows: DataFrame, part: Column, wanted: int) -> tuple[int | None, int]:
        """(the part that holds the wanted-th row, rows before it); None where there are fewer rows."""
        before = 0
        for value, count in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()):
            if before + count >= wanted:
                return value, before
            before += count
        return None, before

    high = F.floor(F.col("_key") / MIX_HALF)
    top, before = cut(keyed, high, n)
    if top is None:
        return stories
    within = keyed.where(high == top)
    value, more = cut(within, F.col("_key"), n - before)
    rest = n - before - more
    tied = keyed.where(F.col("_key") == value).orderBy("stories_id").limit(rest)
    return keyed.where(F.col("_key") < value).unionByName(tied).drop("_key")


def page(stories: DataFrame, start: int, rows: int) -> DataFrame:
    """Rows [start, start + rows) of the stories ordered by id (the source's start/rows paging).

    Up to ``TOP_K`` rows deep this is a top-k. Deeper, the ids are cut into ranges, the ranges' row counts
    are added up, and only the ranges that hold the page go on (a pushed-down filter on the id), cut
    again until few rows stand before the page; nothing but range counts comes to the driver."""
    if start + rows <= TOP_K:
        return stories.orderBy("stories_id").offset(start).limit(rows)
    return deep_page(stories, start, rows)


def deep_page(stories: DataFrame, start: int, rows: int) -> DataFrame:
    """``page`` by ranges, at any depth."""
    held, skip = _ranges_of(stories, start, rows)
    order = Window.orderBy(F.col("stories_id").asc_nulls_first())
    at = F.row_number().over(order)
    return held.withColumn("_at", at).where((F.col("_at") > skip) & (F.col("_at") <= skip + rows)).drop("_at")


def _ranges_of(stories: DataFrame, start: int, rows: int) -> tuple[DataFrame, int]:
    """The id ranges that hold rows [start, start + rows), and how many of their rows stand before them."""
    held, skip, size = stories, start, None
    while True:
        cuts = held.agg(F.approx_percentile("stories_id", [i / PAGE_RANGES for i in range(1, PAGE_RANGES)], 10 * PAGE_RANGES)).first()[0] or []
        cuts = sorted(set(cuts))
        # range i: ids over cuts[i - 1] up to cuts[i]; null ids are in the first one
        no = F.lit(0)
        if cuts:
            edges = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
            no = F.coalesce(F.size(F.filter(edges, lambda c: c < F.col("stories_id"))), F.lit(0))
        counts = sorted(tuple(r) for r in held.groupBy(no.alias("no")).agg(F.count(F.lit(1))).collect())
        before, first, last, kept, lead = 0, None, None, 0, 0
        for i, n in counts:
            if before + n > skip and before < skip + rows:
                first, last = (i if first is None else first), i
                lead = before if kept == 0 else lead
                kept += n
            before += n
        if first is None:  # the page lies behind the last row
            return held.where(F.lit(False)), 0
        bounds = F.lit(True)
        if first > 0:
            bounds = bounds & (F.col("stories_id") > cuts[first - 1])
        if last < len(cuts):
            bounds = bounds & ((F.col("stories_id") <= cuts[last]) if first > 0 else ((F.col("stories_id") <= cuts[last]) | F.col("stories_id").isNull()))
        narrowed = held.where(bounds) if first > 0 or last < len(cuts) else held
        if kept <= rows + PAGE_REST or kept == size:  # few rows, or rows of equal ids that no cut parts
            return narrowed, skip - lead
        held, skip, size = narrowed, skip - lead, kept
