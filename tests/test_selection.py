"""Large samples, deep pages and gated name rewrites give the rows of the plain forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstat.functions import names as N
from quillstat.functions.text import strip_ws
from quillstat.operators import sampling as S


def _ids(spark, n, seed, copies=False):
    rng = random.Random(seed)
    ids = list(dict.fromkeys(rng.randrange(10 ** rng.randint(3, 18)) * rng.choice([1, 1, -1]) for _ in range(2 * n)))[:n]
    if copies:
        ids += [ids[0]] * (n // 2) + [None] * 3
    rng.shuffle(ids)
    return ids, spark.createDataFrame([(i, f"u{k}") for k, i in enumerate(ids)], "stories_id long, url string").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1999, 2000, 5000])
def test_a_sample_below_the_cut_is_the_sample(spark, n):
    _, df = _ids(spark, 2000, 1)
    want = {tuple(r) for r in df.orderBy(S.mix_key(1), "stories_id").limit(n).collect()}
    got = [tuple(r) for r in S.sample_below_cut(df, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_samples_with_equal_and_null_ids(spark):
    ids, df = _ids(spark, 300, 2, copies=True)
    for n in (2, 3, 4, 100, 452, 453):
        want = sorted((str(r[0]) for r in df.orderBy(S.mix_key(1), "stories_id").limit(n).select("stories_id").collect()))
        assert sorted(str(r[0]) for r in S.sample_below_cut(df, n).select("stories_id").collect()) == want


@pytest.mark.parametrize("copies", [False, True])
def test_deep_pages(spark, monkeypatch, copies):
    monkeypatch.setattr(S, "PAGE_RANGES", 4)
    monkeypatch.setattr(S, "PAGE_REST", 20)
    ids, df = _ids(spark, 1500, 3, copies)
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    for start, rows in ((0, 10), (1, 5), (700, 50), (len(ids) - 3, 10), (len(ids), 5), (900, 2000), (10, 0)):
        got = [r[0] for r in S.deep_page(df, start, rows).select("stories_id").collect()]
        assert sorted(got, key=str) == sorted(order[start:start + rows], key=str), (start, rows)


def test_deep_pages_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "PAGE_REST", 1000)
    df = spark.range(200_000).select((F.col("id") * 7).alias("stories_id"))
    held, skip = S._ranges_of(df, 150_000, 10)
    assert held.count() <= 1010 and skip <= 1000
    assert [r[0] for r in S.page(df, 150_000, 3).collect()] == [1_050_000, 1_050_007, 1_050_014]
    plan = S.page(df, 150_000, 3)._jdf.queryExecution().executedPlan().toString()
    assert all(int(n) <= 1010 for n in re.findall(r"limit=(\d+)", plan))  # not 150,003
    assert "TakeOrdered" in S.page(df, 100, 3)._jdf.queryExecution().executedPlan().toString()


def test_gated_rewrites_equal_the_plain_order(spark):
    rng = random.Random(5)
    bits = ["ada", "moor", " ", "  ", " at", " in ", " is ", "a", "by ", "By ", " by ", "dr ", "| ", "\n", "\t", "\x1c", "sir", "gov.", "rep", "president", "professor",
            "rt revd", "general sir ", "graphics by:", "graphic by", "compiled ", "exclusive ", " for ", "interviewed ", "interviews ", " covers", " info", " writes ",
            "founder of", "view author", "more stories by ", "as told to ", "special dispatch", "american way: ", "é", "", ".", "pre", "siden", "t"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 7)))) for i in range(6000)] + [(6000, None)]
    df = spark.createDataFrame(rows, "i int, s string")
    plain = F.col("s")
    for p, r in N.EXTRAS_REWRITES:
        plain = F.regexp_replace(plain, "(?d)" + p, r)
    got = df.select("i", N.strip_extras("s").alias("a"), strip_ws(plain).alias("b"), F.col("s").rlike(N.rewrite_trigger([p for p, _ in N.EXTRAS_REWRITES])).alias("t")).collect()
    assert all(r["a"] == r["b"] for r in got) and 500 < sum(bool(r["t"]) for r in got) < 5900
