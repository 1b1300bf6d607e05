"""Golden rows for the name functions (FIXTURES §3-§5)."""

import pytest
from pyspark.sql import functions as F

from quillstat.functions import names as N

FIRST = [
    ("J. Corwin Varley", ["Corwin"]),
    ("J. Varley", [None]),
    ("J Varley", [None]),
    ("J N Varley", [None]),
    ("J. N. Varley", [None]),
    ("JN Varley", ["JN"]),
    ("Varley, J. Corwin", ["Corwin"]),
    ("Farrow, Odette", ["Odette"]),
    ("Odette Farrow", ["Odette"]),
    ("Corwin Varley and Odette Farrow", ["Corwin", "Odette"]),
    ("J. Corwin Varley and Odette Farrow", ["Corwin", "Odette"]),
    ("", [None]),
    (None, []),
    ("AP/April 18, 2013, 8:46 PM", []),
    ("Rob Tarrant, Chronicle Staff Writer", []),
    ("THE ASSOCIATED PRESS", ["THE"]),
    ("U.S. News", [None]),
    ("Madonna", [None]),
    ("Madonna.", ["Madonna"]),
    ("Smith and Jones, Bob", [None, "Jones"]),
    ("a lee; b cho and c diaz, d evans", ["lee", "diaz"]),
]

FULL = [
    ("RUFUS OLDEN", ["rufus olden"]),
    ("Ivor Stanley and Beatrix Holloway", ["ivor stanley", "beatrix holloway"]),
    ("Rob Tarrant, Chronicle Staff Writer", ["rob tarrant", "chronicle staff writer"]),
    ("Varley, J. Corwin", ["varley", "j. corwin"]),
    ("Farrow, Odette", []),
    ("Smith and Jones, Bob", ["smith"]),
    ("a lee; b cho and c diaz, d evans", ["a lee", "b cho", "c diaz", "d evans"]),
    ("Sportswire Reporter", ["sportswire orter"]),
    ("AP/April 18, 2013, 8:46 PM", []),
    ("", []),
    (None, []),
]

EXTRAS = [
    ("rufus olden", "rufus olden"),
    ("professor ann lee", "essor ann lee"),
    ("by piers shortbbc news", "piers shortbbc news"),
    ("chet atkins", "chet"),
    ("ann lee for reuters", "ann lee"),
    ("gov. jane roe", "jane roe"),
    ("sir john smith", "john smith"),
    ("more stories by imogen castle", "imogen castle"),
    ("jane  roe", "jane"),
    ("dr ann lee", "ann lee"),
    ("the rt revd john smith", "john smith"),
    ("ann reporter", "ann orter"),
    ("jane roe is a writer", "jane roe"),
    ("photos by jane roe", "jane roe"),
]


def _run(spark, rows, fn):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: r.o for r in df.select("i", fn(F.col("s")).alias("o")).collect()}
    return [got[i] for i in range(len(rows))]


def test_first_names(spark):
    got = _run(spark, FIRST, N.first_names)
    for (inp, exp), g in zip(FIRST, got):
        assert list(g) == exp, (inp, g, exp)


def test_full_names(spark):
    got = _run(spark, FULL, N.full_names)
    for (inp, exp), g in zip(FULL, got):
        assert list(g) == exp, (inp, g, exp)


def test_strip_extras(spark):
    got = _run(spark, EXTRAS, N.strip_extras)
    for (inp, exp), g in zip(EXTRAS, got):
        assert g == exp, (inp, g, exp)
