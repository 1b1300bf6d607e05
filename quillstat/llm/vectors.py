"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector x is turned by a random rotation; the signs of its coordinates are its code, and the
code's own unit vector is b. Stored beside it is the factor a = <x, b>. For any unit vector y, <y, b> / a
is an unbiased estimate of the cosine <x, y>; at a cosine c it is off by at most
sqrt(1 - c^2) * sqrt(1 - a^2) / a * s / sqrt(D - 1), but for a chance that falls as exp(-s^2 / 2) and is
nil from s = sqrt(D - 1) on. So a pair whose estimate lies below the threshold by more than that is
dropped, and every other one is recomputed exactly, in double precision.

Which pairs meet: codes of ``CODE_BITS`` bits at least (more rotations where a vector has fewer
coordinates), and tables that each take some of their bits as a bucket. The bits of a table grow with the
logarithm of the largest label's number of vectors, so that buckets stay small, and the number of tables follows
from the chance ``RECALL`` that a pair right at the threshold shares a bucket of one of them
(closer pairs: a higher one). In a bucket only codes move at first, and only vectors that have another
one within reach by their codes' differing bits go on to the estimates. A pair is taken in the
first table that it shares, so it counts once. Buckets of more than ``BUCKET_ROWS`` vectors are compared as
pairs of slices. Equal vectors of one label are one node with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.blocks import HIGH, LOW, OWN, dealt, paired_slices, whole_groups
from quillstat.llm.common import written
from quillstat.llm.components import SALTS, components

COSINE = 0.98
SEED = 13
CODE_BITS = 128
RECALL = 0.9995
#: Confidence of the bounds, in standard deviations: a pair is lost to them once in 10^9.
SIGMAS = 6.0
BUCKET_ROWS = 4096
AT_ONCE = 512


def rotation(dims: int, number: int = 0) -> np.ndarray:
    """A random rotation (or reflection), the same wherever it is asked for."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes and factors of the unit vectors of one length."""

    def __init__(self, dims: int):
        self.dims = dims
        self.turns = [rotation(dims, i) for i in range(max(1, -(-CODE_BITS // dims)))]
        self.bits = max(dims, CODE_BITS)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, words) uint64 codes, whose first bits are those of the first rotation, and factors."""
        first = unit @ self.turns[0]
        factor = np.abs(first).sum(1) / math.sqrt(self.dims)
        turned = [first, *(unit @ t for t in self.turns[1:])]
        signs = (np.hstack(turned) > 0)[:, :self.bits]
        packed = np.packbits(np.pad(signs, ((0, 0), (0, -self.bits % 64))), axis=1, bitorder="little")
        return np.ascontiguousarray(packed).view("<u8"), factor

    def code_vectors(self, code: np.ndarray) -> np.ndarray:
        """The unit vectors b of codes, in rotated coordinates."""
        bits = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")[:, :self.dims]
        return (2 * bits.astype(np.float32) - 1) / np.float32(math.sqrt(self.dims))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def slack(factor: np.ndarray, cosine: float, dims: int, sigmas: float = SIGMAS) -> np.ndarray:
    """How far below ``cosine`` the estimate of a pair with that cosine or a higher one can lie."""
    spread = min(1.0, sigmas / math.sqrt(dims - 1)) if dims > 1 else 0.0
    return math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor * spread + 1e-5


def differing(cosine: float, bits: int) -> np.ndarray:
    """Chances that 0, 1, ... of so many code bits differ at this cosine."""
    p = math.acos(cosine) / math.pi
    logs = [math.lgamma(bits + 1) - math.lgamma(h + 1) - math.lgamma(bits - h + 1) + h * math.log(p) + (bits - h) * math.log1p(-p)
            for h in range(bits + 1)]
    return np.exp(logs)


def most_differing(cosine: float, bits: int = CODE_BITS, lost: float = 1e-6) -> int:
    """Code bits in which all but ``lost`` of the pairs at this cosine differ at most."""
    return int(np.searchsorted(np.cumsum(differing(cosine, bits)), 1 - lost))


def tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> np.ndarray:
    """(tables, words) uint64 masks: the code bits that each table takes."""
    taken = min(32, max(8, math.ceil(math.log2(max(n, 2)))))
    chance, h = differing(cosine, CODE_BITS), np.arange(CODE_BITS + 1)
    share = np.prod([np.maximum(0, CODE_BITS - h - i) / (CODE_BITS - i) for i in range(taken)], axis=0)
    number = 1
    while 1 - (chance * (1 - share) ** number).sum() < recall and number < 512:
        number += 1
    rng = np.random.default_rng([SEED, taken])
    masks = np.zeros((number, CODE_BITS), np.uint8)
    for row in masks:
        row[rng.choice(CODE_BITS, taken, replace=False)] = 1
    return np.packbits(masks, axis=1, bitorder="little").view("<u8")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def usable(vector: str = "embedding") -> Column:
    """True for vectors without null or non-finite components and with one that is not zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, embedding, label) with ``h1``, ``h2``: 128 bits of hash of label and vector, null
    for rows that link with nothing."""
    good = F.col("label").isNotNull() & usable()
    return rows.select("vec_id", "label", "embedding", F.when(good, F.xxhash64("label", "embedding")).alias("h1"),
                       F.when(good, F.xxhash64("embedding", F.lit("second"), "label")).alias("h2"))


def nodes(rows: DataFrame) -> DataFrame:
    """The distinct vectors of each label: node, h1, h2, space (hash of label and length), copies, first_id
    (smallest vec_id), embedding, code, factor."""
    distinct = (rows.where("h1 is not null").groupBy("h1", "h2")
                .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"),
                     F.first("embedding").alias("embedding")))
    plain = distinct.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.xxhash64("label", F.size("embedding")).alias("space"),
                            "copies", "first_id", "embedding")

    def encode(batches):
        known: dict[int, Codes] = {}
        for batch in batches:
            flat, at = matrix(batch.column(6))
            sizes = np.diff(at)
            code, factor = [b""] * batch.num_rows, np.zeros(batch.num_rows)
            for dims in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == dims)
                codes = known.setdefault(dims, Codes(dims)) if dims not in known else known[dims]
                words, factor[here] = codes.encode(units(flat[at[here][:, None] + np.arange(dims)]))
                for i, w in zip(here.tolist(), words):
                    code[i] = w.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor)],
                                             names=[*batch.schema.names, "code", "factor"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", code binary, factor double"
    return written(plain.mapInArrow(encode, schema), "nodes")


def words_of(column, most: int | None = None) -> np.ndarray:
    """(n, words) uint64 of a column of codes of one length, or of their first words."""
    values = [v[:8 * most] if most else v for v in column.to_pylist()]
    return np.frombuffer(b"".join(values), "<u8").reshape(len(values), -1)


def buckets(found: DataFrame, masks: np.ndarray) -> DataFrame:
    """(place, tab, node, c0, c1): every node at its bucket of every table."""
    def run(batches):
        for batch in batches:
            space = batch.column(1).to_numpy().view(np.uint64)
            code = words_of(batch.column(2), masks.shape[1])
            for t, mask in enumerate(masks):
                cut = code & mask
                place = mixed(mixed(mixed(space + np.uint64(t + 1)) ^ cut[:, 0]) ^ cut[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(np.full(len(place), t, np.int32)), batch.column(0),
                                                  *(pa.array(np.ascontiguousarray(code[:, i]).view(np.int64)) for i in range(2))],
                                                 names=["place", "tab", "node", "c0", "c1"])

    return found.select("node", "space", "code").mapInArrow(run, "place long, tab int, node long, c0 long, c1 long")


def within_reach(code: np.ndarray, own: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Which rows of a place have another one, of the other slice where there are two, within ``most`` bits."""
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    hit = np.zeros(len(code), bool)
    for a in range(0, len(left), AT_ONCE):
        part = left[a:a + AT_ONCE]
        near = sum(np.bitwise_count(code[part, w][:, None] ^ code[right, w]).astype(np.uint16) for w in range(code.shape[1])) <= most
        if low == high:
            near[np.arange(len(part)), a + np.arange(len(part))] = False
        hit[part] |= near.any(1)
        hit[right] |= near.any(0)
    return hit


def candidates(at: DataFrame, most: int, bucket_rows: int) -> DataFrame:
    """(place, slices, tab, node): the members of buckets that have another one within reach."""
    rows = paired_slices(at, "place", F.col("node"), bucket_rows).select("place", LOW, HIGH, OWN, "tab", "node", "c0", "c1")

    def run(batches):
        for table, edges in whole_groups(batches, 3):
            low, high, own = (table.column(i).to_numpy() for i in (1, 2, 3))
            code = np.stack([table.column(i).to_numpy().view(np.uint64) for i in (6, 7)], axis=1)
            sizes, hit = np.diff(edges), np.zeros(table.num_rows, bool)
            two = edges[:-1][sizes == 2]
            two = two[(low[two] == high[two]) | (own[two] != own[two + 1])]
            near = two[np.bitwise_count(code[two] ^ code[two + 1]).sum(1) <= most]
            hit[near] = hit[near + 1] = True
            for i in np.flatnonzero(sizes > 2).tolist():
                a, b = edges[i], edges[i + 1]
                hit[a:b] = within_reach(code[a:b], own[a:b], low[a], high[a], most)
            yield from table.select(range(6)).filter(pa.array(hit)).to_batches()

    return dealt(rows, "place").mapInArrow(run, f"place long, {LOW} int, {HIGH} int, {OWN} int, tab int, node long")


class Compare:
    """The links among the vectors of a bucket."""

    def __init__(self, masks: np.ndarray, cosine: float, sigmas: float):
        self.masks, self.cosine, self.sigmas = masks, cosine, sigmas
        self.known: dict[int, Codes] = {}
        self.estimated = self.recomputed = 0

    def pairs(self, unit: np.ndarray, code: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray):
        """Pairs of rows (i of ``left``, j of ``right``) with at least the cosine; for left = right each pair once."""
        dims = unit.shape[1]
        if dims not in self.known:
            self.known[dims] = Codes(dims)
        codes, same = self.known[dims], left is right
        asked = (unit[right] @ codes.turns[0]).astype(np.float32)
        for a in range(0, len(left), AT_ONCE):
            part = left[a:a + AT_ONCE]
            estimate = codes.code_vectors(code[part]) @ asked.T / factor[part][:, None].astype(np.float32)
            may = estimate >= (self.cosine - slack(factor[part], self.cosine, dims, self.sigmas))[:, None]
            if same:
                may &= np.arange(len(right)) > a + np.arange(len(part))[:, None]
            i, j = np.nonzero(may)
            self.estimated += may.size
            self.recomputed += len(i)
            for b in range(0, len(i), 1 << 16):  # exactly, so many pairs at once
                x, y = part[i[b:b + (1 << 16)]], right[j[b:b + (1 << 16)]]
                hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= self.cosine
                yield x[hit], y[hit]

    def first_shared(self, code: np.ndarray, x: np.ndarray, y: np.ndarray, tab: int) -> np.ndarray:
        """Whether ``tab`` is the first table that the pairs share."""
        n = self.masks.shape[1]
        apart = code[x][:, :n] ^ code[y][:, :n]
        first = ~(apart & self.masks[tab]).any(1)
        for mask in self.masks[:tab]:
            first &= (apart & mask).any(1)
        return first

    def bucket(self, node, space, copies, unit, code, factor, own, low: int, high: int, tab: int):
        """(nodes, links counted with copies), (u, v): links that join the bucket's components."""
        left = np.flatnonzero(own == low)
        right = left if low == high else np.flatnonzero(own == high)
        count, group, us, vs = np.zeros(len(node), np.int64), np.arange(len(node)), [], []
        for x, y in self.pairs(unit, code, factor, left, right):
            taken = (space[x] == space[y]) & self.first_shared(code, x, y, tab)
            x, y = x[taken], y[taken]
            np.add.at(count, x, copies[y])
            np.add.at(count, y, copies[x])
            cuts = np.flatnonzero(np.diff(x)) + 1  # x is in order: one stretch of pairs for each
            for xs, ys in zip(np.split(x, cuts), np.split(y, cuts)):
                if not len(xs):
                    continue
                i, others = xs[0], group[ys]
                fresh = others != group[i]
                if fresh.any():  # joined to what it has not been joined to
                    roots, at = np.unique(others[fresh], return_index=True)
                    us.extend([node[i]] * len(roots))
                    vs.extend(node[ys[fresh][at]])
                    group[np.isin(group, roots)] = group[i]
        linked = count > 0
        return node[linked], count[linked], us, vs


def links(found: DataFrame, wanted: DataFrame, masks: np.ndarray, cosine: float, sigmas: float) -> DataFrame:
    """(u, n, v): how many vectors node u links with (v null), and links u, v that join the components."""
    rows = wanted.join(found.select("node", "space", "copies", "embedding", "code", "factor"), "node").select(
        "place", LOW, HIGH, OWN, "tab", "node", "space", "copies", "embedding", "code", "factor")

    def run(batches):
        compare = Compare(masks, cosine, sigmas)
        for table, edges in whole_groups(batches, 3):
            low, high, own, tab, node, space, copies = (table.column(i).to_numpy() for i in range(1, 8))
            flat, at = matrix(table.column(8))
            factor, code = table.column(10).to_numpy(), table.column(9)
            u, n, v = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                dims = int(at[a + 1] - at[a])
                if b - a < 2 or (np.diff(at[a:b + 1]) != dims).any():
                    continue
                unit = units(flat[at[a]:at[b]].reshape(b - a, dims))
                part = compare.bucket(node[a:b], space[a:b], copies[a:b], unit, words_of(code.slice(a, b - a)), factor[a:b], own[a:b],
                                      low[a], high[a], int(tab[a]))
                u.extend([*part[0], *part[2]])
                n.extend([*part[1], *[None] * len(part[2])])
                v.extend([*[None] * len(part[0]), *part[3]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, n, v)], names=["u", "n", "v"])

    return dealt(rows, "place").mapInArrow(run, "u long, n long, v long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sigmas: float = SIGMAS,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row for each.

    Rows of one label (not null) and one length link at a cosine of at least ``cosine`` (0 < cosine < 1).
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links is 0 and
    component_id their own id. A repeated row is a vector of its own, linked with its copies. A null vec_id
    counts as a link of others but is no component_id while another id is reachable, and is not kept. Other
    columns are not read; an empty table gives no rows. No pair below ``cosine`` links; a pair right at
    it is met with a chance of ``recall``, closer ones more surely."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine has to lie between 0 and 1")
    rows = keyed(vectors)
    found = nodes(rows)
    most = found.groupBy("space").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    masks = tables(most, cosine, recall)
    wanted = candidates(buckets(found, masks), most_differing(cosine), bucket_rows)
    made = written(links(found, wanted, masks, cosine, sigmas), "vector-links")
    counts = made.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(made.where("v is not null").select("u", "v"))
    rooted = written(found.select("node", "h1", "h2", "copies", "first_id").join(counts, "node", "left").join(joined, "node", "left")
                     .select("h1", "h2", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("root", "node").alias("root")), "rooted-vectors")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = rooted.where("n_links > 0").join(named, "root").select("h1", "h2", "n_links", "component_id")
    # copies of one vector are spread over salted keys
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    component = F.coalesce("component_id", "vec_id")
    return salted.join(told, ["h1", "h2", "salt"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
