"""Document fingerprints: bottom-k sketches of word shingles, as Spark SQL expressions.

A sketch is the sorted array of the ``K`` smallest distinct 64-bit hashes of a text's
shingles of five words (fewer words: one shingle of all; none: an empty array). The
sketch of a union is the bottom k of the union of sketches, so parts can be sketched apart
and merged. From two sketches come resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import let, read_partitions, text_hash, written

K = 128
WORDS = 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch of a text (null: empty), ASCII white space between words."""
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)),
                           lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(words)]))
        return (F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
                .otherwise(F.array().cast("array<bigint>")))

    return bottom(let(split, shingles), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what ``a`` and ``b`` sketch."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1 (two empty sketches: 1)."""
    both = F.array_intersect(a, b)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(u, both)).cast("double") / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    part = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(part, F.lit(2.0 ** -64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1 (an empty a: 1)."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(a: Column) -> Column:
    """A sketch as one string: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def from_text(text: Column) -> Column:
    """The sketch of a string made by ``as_text``."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest((F.length(text) / 16).cast("int"), F.lit(1))),
                        lambda i: F.conv(F.substr(text, (i - 1) * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(parts)


def followers(docs: DataFrame) -> DataFrame:
    """(id, h, n, next_id, next_h): each distinct document and the next one in order of id (then of
    text hash); after the last comes the first. No global sort in one task: ranges of ids are
    sorted apart, and the last row of a range takes the first row of the next range. The ranges are
    written once, in as many files as the texts are read in, not in a file for each range."""
    ids = docs.select("id", "h", F.length("text").cast("long").alias("n")).distinct()
    ranges = ids.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id())
    dealt = written(ranges.coalesce(read_partitions(docs)), "order")
    row = F.struct("id", "h")
    inside = dealt.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy("id", "h")))
    firsts = dealt.groupBy("part").agg(F.min(row).alias("first"))
    after = Window.orderBy("part").rowsBetween(1, 1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.max("first").over(after), F.min("first").over(every)).alias("next_first"))
    chosen = inside.join(firsts, "part").select("id", "h", "n", F.coalesce("next", "next_first").alias("next"))
    return chosen.select("id", "h", "n", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Every row's sketch, that of its edited text (the last quarter of the code points replaced by the
    first as many of the next document) and both likenesses; see the README for the columns.

    Repeated rows (same id and text) are one document in the order and give the same result;
    a null id comes first; a table of one document follows itself; an empty one gives no rows. Texts are
    sketched whole at any length; other columns are ignored whatever their names. Ids are longs."""
    # both branches read the same three columns, so the texts are shuffled once
    known = F.col("doc_id").isNotNull()
    keyed = docs.select(F.struct(known.alias("known"), F.coalesce("doc_id", F.lit(0)).alias("value")).alias("id"), text_hash().alias("h"),
                        F.coalesce("text", F.lit("")).alias("text"))
    order = followers(keyed)
    back = order.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("of_id"),
                        F.col("h").alias("of_h"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = (keyed.join(back, ["id", "h"])
             .select("of_id", "of_h", F.substr("text", F.lit(1), F.col("take")).alias("head"), sketch(F.col("text"), k).alias("next_sketch"))
             .dropDuplicates(["of_id", "of_h"]))
    whole = keyed.join(heads, (F.col("id") == F.col("of_id")) & (F.col("h") == F.col("of_h")))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    made = whole.select(F.when(F.col("id.known"), F.col("id.value")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"),
                        sketch(F.col("text"), k).alias("own"), "next_sketch")
    made = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own",
                       sketch(F.col("edited"), k).alias("other"), "next_sketch")
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("other")).alias("edited_fingerprint"),
                       resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
                       resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
                       F.round(distinct_shingles(F.col("own"), k), 1).alias("n_shingles"),
                       containment(F.col("own"), F.col("other"), k).alias("contained_in_edited"))
