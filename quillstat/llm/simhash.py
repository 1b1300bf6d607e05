"""SimHash near-duplicates by anchor-point covering.

Fingerprints link when at most ``MAX_BITS`` of their 64 bits differ. Then one of the two
32-bit halves differs in at most one bit. For each half the anchors are the code words of
the perfect Hamming code of length 31 (covering radius 1: every value has its anchor within
one bit). A fingerprint is sent to every anchor within radius plus threshold, 1 + 1 = 2 bits
(1 or 16 anchors), so any two linked fingerprints meet at the anchor nearest to one
of them; they are compared there over all 64 bits. Used on 64 bits at once, a code would
need thousands of anchors for each fingerprint at the same selectivity.

Equal fingerprints are one node, so copies cost nothing. At an anchor, members are walked
from one to its still unreached neighbours, which gives the anchor's components without
listing all pairs of a dense group.

An anchor with very many members is split: two linked fingerprints differ in at most three
bits, so one of the four bytes of the half that the anchor does not cover is equal, and the members
meet again at (anchor, byte, its value), in tasks of their own; a value that very many of them
share is compared as pairs of slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.blocks import HIGH, LOW, dealt, paired_slices, whole_groups
from quillstat.llm.common import map_text, quoted, text_hash, unused, written
from quillstat.llm.components import components

MAX_BITS = 3
WORDS = 3
SEED = 42
CODE_BITS = 31
SHINGLES_AT_ONCE = 1 << 16
#: An anchor with more members than this is split by the bytes of the other half.
SPLIT_MEMBERS = 4096
#: Split anchors up to this number (one long each) are broadcast; more are joined by a shuffle.
BROADCAST_ANCHORS = 1_000_000
#: Low bits of a place's number that tell byte and value of a split anchor (zero: an anchor as it is).
PLACE_BITS = 11


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text: bit set where over half of the shingle hashes have it."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    spans = list(zip(starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist()))
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = np.array([hashed(joined[a:b], SEED) for a, b in spans[at:at + SHINGLES_AT_ONCE]], "<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, columns: list[str], words: int = WORDS) -> DataFrame:
    """``columns`` of ``docs`` (text among them) plus ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: {"fp": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))}

    return map_text(docs, columns, "fp long", make)


def anchors(half: Column) -> Column:
    """Code words of the Hamming code within two bits of a 31-bit value."""
    checks = [sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1) for k in range(5)]
    syndrome = F.lit(0).cast("long")
    for k, check in enumerate(checks):
        syndrome = syndrome.bitwiseOR(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(check))).bitwiseAND(F.lit(1)).cast("long"), k))
    bits = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << p).cast("long") for p in range(CODE_BITS)]])

    def words(s: Column) -> Column:
        flip = lambda x, i: x.bitwiseXOR(F.element_at(bits, (i + 1).cast("int")))
        pairs = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(CODE_BITS).cast("long")), lambda i: i < i.bitwiseXOR(s))
        two = F.transform(pairs, lambda i: flip(flip(half, i), i.bitwiseXOR(s)))
        return F.when(s == 0, F.array(half)).otherwise(F.concat(F.array(flip(half, s)), two))

    return F.element_at(F.transform(F.array(syndrome), words), 1)


def at_anchors(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp) to (anchor, fp), one row for each anchor in reach, both halves."""
    low = (1 << CODE_BITS) - 1
    halves = [F.col("fp").bitwiseAND(F.lit(low)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(low))]
    second = F.transform(anchors(halves[1]), lambda a: a.bitwiseOR(F.lit(1 << CODE_BITS)))
    return nodes.select(F.explode(F.concat(anchors(halves[0]), second)).alias("anchor"), "fp")


def meeting_places(nodes: DataFrame, max_bits: int = MAX_BITS, split: int = SPLIT_MEMBERS) -> DataFrame:
    """``nodes`` (fp) to (place, fp, slices): an anchor, or with more than ``split`` members its four
    bytes' values, or where one of these has more than ``split`` again, the pairs of its slices. Any two fingerprints
    within ``max_bits`` (up to 3) share a place and pair."""
    if max_bits > MAX_BITS:
        raise ValueError(f"anchors of radius 1 on halves cover at most {MAX_BITS} bits")
    met = at_anchors(nodes)
    full = written(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > split)
                   .select("anchor", F.lit(True).alias("full")), "full-anchors")
    n = full.count()
    whole = F.shiftleft("anchor", PLACE_BITS)
    if not n:
        return met.select(whole.alias("place"), "fp", *[F.lit(0).alias(c) for c in (LOW, HIGH)])
    marked = met.join(F.broadcast(full) if n <= BROADCAST_ANCHORS else full, "anchor", "left")
    # the anchor's bit 31 tells which half it is of; the bytes are those of the other one
    other = F.when(F.col("anchor") < F.lit(1 << CODE_BITS), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = [F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)) + F.lit(1 + 256 * k) for k in range(4)]
    places = F.when(F.col("full"), F.transform(F.array(*parts), lambda x: whole.bitwiseOR(x))).otherwise(F.array(whole))
    met = marked.select(F.explode(places).alias("place"), "fp")
    # a byte's value that very many members share is compared as pairs of slices
    is_split = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) != 0
    again = paired_slices(met.where(is_split), "place", F.col("fp"), split)
    return met.where(~is_split).select("place", "fp", *[F.lit(0).alias(c) for c in (LOW, HIGH)]).unionByName(again.select("place", "fp", LOW, HIGH))


def spanning_links(values: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that join the members of one anchor as all links between them would: each member
    is compared with those no earlier one has reached."""
    left, us, vs = values, [], []
    todo: list = []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        u = todo.pop()
        near = np.bitwise_count(left ^ u) <= max_bits
        if near.any():
            reached = left[near]
            left = left[~near]
            us.extend([u] * len(reached))
            vs.extend(reached)
            todo.extend(reached)
    return us, vs


def links(nodes: DataFrame, max_bits: int = MAX_BITS, split: int = SPLIT_MEMBERS) -> DataFrame:
    """(u, v): links between distinct fingerprints, enough to join each component."""
    met = dealt(meeting_places(nodes, max_bits, split).select("place", LOW, HIGH, "fp"), "place")

    def run(batches):
        for table, edges in whole_groups(batches, 3):
            fp, sizes = table.column(3).to_numpy().view(np.uint64), np.diff(edges)
            two = edges[:-1][sizes == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            us, vs = fp[near].tolist(), fp[near + 1].tolist()
            for i in np.flatnonzero(sizes > 2).tolist():
                u, v = spanning_links(fp[edges[i]:edges[i + 1]], max_bits)
                us.extend(u)
                vs.extend(v)
            if us:
                pairs = np.unique(np.sort(np.array([us, vs], np.uint64).view(np.int64), 0), axis=1)
                yield pa.RecordBatch.from_pydict({"u": pa.array(pairs[1]), "v": pa.array(pairs[0])})

    return met.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS) -> DataFrame:
    """doc_id, h (hash of the text), fp, component_id, root (the group's smallest fingerprint) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, itself included (null only where
    all ids reachable are null). A null or empty text has fingerprint zero, linked like
    any other; repeated rows belong together; an empty table gives no rows."""
    rows = written(fingerprints(docs.select("doc_id", text_hash().alias("h"), "text"), ["doc_id", "h", "text"], words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(nodes.select("fp"), max_bits))
    rooted = (nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    rooted = written(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(named, "root")
    return rows.join(of_fp, "fp").select("doc_id", "h", "fp", "component_id", "root")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: that with the smallest id,
    nulls last (rows that share it: the one with the smallest text hash, once). An id in several
    unlinked groups can stand for each of them."""
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("h"))
    first = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("least")).select("least.doc_id", "least.h")
    # plain equal keys (a null id as zero and a flag), so that the semi join and the removal of
    # repeated rows share one exchange of the texts
    keys = [unused(k, docs.columns) for k in ("key_id", "key_null", "key_hash")]

    def key_columns(h: Column) -> list[Column]:
        values = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), h]
        return [v.alias(k) for k, v in zip(keys, values)]

    hashed = docs.select("*", *key_columns(text_hash()))
    kept = hashed.join(first.select(*key_columns(F.col("h"))), keys, "left_semi")
    return kept.dropDuplicates(keys).select(*quoted(docs.columns))
