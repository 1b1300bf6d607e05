"""Hard negatives, spelling variants and near vectors against brute force: nulls, empty and long
texts, ties, repeated rows, empty tables, clashing columns, large groups."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.llm import negatives, queries, spelling, vectors

NAN, INF = float("nan"), float("inf")


# ---- spelling variants

def near_by_deletion(words):
    """word -> set of words one edit away, from equal texts after one deletion, checked letter by letter."""
    holes = collections.defaultdict(set)
    for w in words:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            holes[k].add(w)

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: set() for w in words}
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w and one(w, x))
    return near


def brute_variants(counts):
    near = near_by_deletion(counts)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def brute_counts(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def spelled(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("block_words", [spelling.BLOCK_WORDS, 4])
def test_variants_of_words(spark, block_words):
    random.seed(11)
    bases = ["abcdefg", "aaaaaaa", "aaaaaaaa", "banana bandana".replace(" ", ""), "übermäßig", "ÿÿÿÿÿÿÿÿ", "straßen", "\U00010d45" * 8]
    counts = {}
    for base in bases:
        counts[base] = random.choice([5000, 400, 30])
        for _ in range(60):
            w = base
            for _ in range(random.randint(1, 3)):
                i, c = random.randrange(len(w)), random.choice("abz")
                w = random.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c])
            counts.setdefault(w, random.choice([2, 2, 3, 20, 45, 400]))
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 5, "x")]
    df = spark.createDataFrame(rows, "word string, n long, form string")
    assert spelled(spelling.variants(df, block_words=block_words)) == sorted(brute_variants(counts), key=repr)


def test_short_words_and_repeated_rows(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "aab", "aba", "b"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    counts = collections.Counter({w: 3 * words.count(w) for w in words})
    assert spelled(spelling.variants(df)) == sorted(brute_variants(counts), key=repr)
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_of_documents(spark):
    long = " ".join(random.Random(4).choices(["Documentation", "documentatio", "reading", "readings", "Àpropos", "àpropos", "x9y"], k=200_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "Several several SEVERAL sev×eral severaal-severaal", "a"), (3, "Several several", "a"),
            (None, "several several nulled nulledx", "a"), (5, long, "a"), (6, "1234567 !!", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = brute_counts([("" if d is None else d, t) for d, t, _ in rows])
    assert counts and spelled(spelling.spelling_variants(df)) == sorted(brute_variants(counts), key=repr)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_spelling_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = spelled(queries.QUERIES["op12_spelling_variants"](spark, sf))
    assert got == sorted(brute_variants(brute_counts(rows)), key=repr) and any(r[1] for r in got)


# ---- near vectors

def brute_links(rows):
    """rows (id, vector, label) to a list of (id, links, component, kept), in their order."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    us = [unit(v) for _, v, _ in rows]
    group, count = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if us[i] is not None and us[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(us[i]) == len(us[j]):
                if us[i] @ us[j] >= 0.98:
                    count[i] += 1
                    count[j] += 1
                    group[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return sorted([(rows[i][0], count[i], least[find(i)], rows[i][0] is not None and rows[i][0] == least[find(i)]) for i in range(len(rows))], key=repr)


def vector_rows(dims, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((centre + rng.standard_normal(dims) * rng.choice([0.01, 0.1, 0.15, 0.3])).tolist())
    dense = rng.standard_normal(dims)
    rows += [(dense + rng.standard_normal(dims) * 0.12).tolist() for _ in range(150)]
    rows += [rows[3]] * 40  # copies
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[k], int(rng.integers(0, 2)) if i % 10 else 1) for i, k in enumerate(order)]


@pytest.mark.parametrize("dims,bucket_rows", [(64, vectors.BUCKET_ROWS), (64, 16), (24, 64), (200, 16)])
def test_near_vectors(spark, dims, bucket_rows):
    rows = vector_rows(dims, dims)
    odd = [(900_001, None, 1), (900_002, [], 1), (900_003, [0.0] * dims, 1), (900_004, [NAN] + [1.0] * (dims - 1), 1), (900_005, [INF] * dims, 1),
           (900_006, [None] + [1.0] * (dims - 1), 1), (900_007, rows[0][1], None), (None, rows[5][1], rows[5][2]), (None, [1e30] * dims, 7),
           (900_008, [1e-30] * dims, 7), (900_009, [1.0] * (dims - 1), 7), (900_010, [1.0], 7), (900_011, [2.0], 7), (900_012, [-1.0], 7), rows[7], rows[7]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, node string, n_links int")
    got = sorted(map(tuple, vectors.near_vectors(df, bucket_rows=bucket_rows).collect()), key=repr)
    assert got == brute_links(rows + odd)


def test_near_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(df).count() == 0
    one = spark.createDataFrame([(4, None, None)], df.schema)
    assert [tuple(r) for r in vectors.near_vectors(one).collect()] == [(4, 0, 4, True)]


def test_estimates_are_unbiased_and_bounded():
    rng, dims = np.random.default_rng(1), 64
    codes = vectors.Codes(dims)
    x = vectors.units(rng.standard_normal((4000, dims)))
    for cosine in (0.98, 0.5, 0.0):
        other = rng.standard_normal((4000, dims))
        other = vectors.units(other - (other * x).sum(1, keepdims=True) * x)
        y = cosine * x + math.sqrt(1 - cosine ** 2) * other
        code, factor = codes.encode(x)
        estimate = (codes.code_vectors(code) * (y @ codes.turns[0])).sum(1) / factor
        assert abs(estimate.mean() - cosine) < 0.01
        if cosine:
            assert (cosine - estimate <= vectors.slack(factor, cosine, dims)).all() and (cosine - estimate <= vectors.slack(factor, cosine, dims, 99)).all()


def test_recall_of_tables_right_at_the_threshold():
    rng, dims, n = np.random.default_rng(2), 64, 20_000
    codes = vectors.Codes(dims)
    x = vectors.units(rng.standard_normal((n, dims)))
    other = rng.standard_normal((n, dims))
    other = vectors.units(other - (other * x).sum(1, keepdims=True) * x)
    a, b = codes.encode(x)[0], codes.encode(0.98 * x + math.sqrt(1 - 0.98 ** 2) * other)[0]
    for rows in (500, 50_000, 10_000_000):
        met = np.zeros(n, bool)
        for mask in vectors.tables(rows):
            met |= ~((a ^ b) & mask).any(1)
        assert met.mean() > 0.998, rows
    assert (np.bitwise_count(a ^ b).sum(1) <= vectors.most_differing(0.98)).mean() > 0.9999


def test_few_pairs_are_recomputed():
    rng = np.random.default_rng(3)
    unit = vectors.units(rng.standard_normal((2000, 64)))
    compare = vectors.Compare(vectors.tables(2000), 0.98, vectors.SIGMAS)
    code, factor = vectors.Codes(64).encode(unit)
    rows = np.arange(2000)
    assert not any(len(x) for x, _ in compare.pairs(unit, code, factor, rows, rows))
    assert compare.recomputed < compare.estimated / 1000


# ---- hard negatives

def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    good = []
    for k, v, label in rows:
        if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((k, [math.floor(256 * x) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for k, v, label in good:
        if not is_anchor(k) or (k, tuple(v), label) in seen:
            continue
        seen.add((k, tuple(v), label))
        every = sorted([(-score(v, q), i, other) for i, q, other in good if i != k])
        best = [(-s, i) for s, i, other in every if other == label][:positives]
        for p, i in best:
            fit = [(-s, j) for s, j, other in every if other != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(k, i, r + 1, j, p, s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [dict(), dict(block_anchors=3, chunk_rows=7, share_rows=50)])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((4, 12)) * 0.3
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 4))
        v = np.round(centre[label] + rng.standard_normal(12) * 0.3, 1)  # rounded: ties
        rows.append((i, v.tolist(), label))
    rows += [rows[10], rows[10], rows[20], rows[31], (20, rows[33][1], 1), (1000, [], 1), (1010, [0.5], 2), (1020, None, 1), (None, rows[1][1], 1),
             (1030, [NAN] + [0.1] * 11, 1), (1040, [None] + [0.1] * 11, 2), (1050, [INF] * 12, 1), (1060, rows[2][1], None), (1070, [0.0] * 12, 0), (1080, [0.5] * 15, 3)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, block string, rank int")
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes).collect()))
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    want = brute_negatives(rows, lambda k: k % 10 == 0)
    assert len(want) > 500 and got == want
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_scores_that_fit_no_long_raise(spark):
    df = spark.createDataFrame([(0, [1e20, 1.0], 1), (1, [1e20, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="may not fit a long"):
        negatives.hard_negatives(df, F.col("vec_id") == 0).collect()


def test_tree_and_bounds():
    rng = np.random.default_rng(5)
    centre = rng.integers(-200, 200, (4, 16))
    anchors = (centre[rng.integers(0, 4, 60)] + rng.integers(-3, 4, (60, 16))).astype(np.int32)
    parent, length, depth = negatives.spanning_tree(anchors)
    assert parent[0] == 0 and length[0] == 0 and all(depth[i] == depth[parent[i]] + 1 for i in range(1, 60))
    # as short as Kruskal's
    far = np.linalg.norm(anchors[:, None].astype(float) - anchors, axis=2)
    group, total = list(range(60)), 0.0
    for i, j in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda e: far[e]):
        if group[i] != group[j]:
            total += far[i, j]
            group = [group[j] if g == group[i] else g for g in group]
    assert abs(length.sum() - total) < 1e-6
    # similar anchors: most candidates are never scored, and the best are right
    row = {"ids": np.arange(60).tobytes(), "labels": np.zeros(60, np.int64).tobytes(), "vectors": anchors.tobytes(), "dims": 16, "parent": parent.tobytes(),
           "length": length.tobytes(), "depth": depth.tobytes(), "windows": [(a, 0, 20_000, 90_000) for a in range(60)]}
    block = negatives.Block(row, 5, False)
    rows = rng.integers(-100, 100, (4000, 16)).astype(np.int32)
    for a in range(0, 4000, 500):
        block.take(np.arange(1000 + a, 1500 + a), np.ones(500, np.int64), rows[a:a + 500])
    exact = anchors.astype(np.int64) @ rows.T.astype(np.int64)
    for a, _, w, s, k in block.found():
        assert exact[a, k - 1000] == s
    for a in range(60):
        fit = sorted(((-s, i) for i, s in enumerate(exact[a].tolist()) if 20_000 <= s <= 90_000))[:5]
        assert [(s, k) for x, _, _, s, k in block.found() if x == a] == [(-s, i + 1000) for s, i in fit]
    assert block.scored < 0.5 * block.bounded


def test_extra_columns_and_order_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    more = df.orderBy(F.rand(3)).select(F.lit("x").alias("a.b"), F.lit(1).alias("chunk"), "*", F.lit(2).alias("share"))
    a, b = (sorted(map(tuple, negatives.hard_negatives(x, F.col("vec_id") % 100 == 0).collect())) for x in (df, more))
    assert a == b
    a, b = (sorted(map(tuple, vectors.near_vectors(x).collect())) for x in (df, more))
    assert a == b
