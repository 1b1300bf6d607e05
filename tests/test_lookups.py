"""Literal lookups, one parse with any name table, gazetteers of any size, late text."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillstat.functions.lookup import bounded_values, member
from quillstat.operators import extract as X
from quillstat.operators import gender as G
from quillstat.operators import mentions as M
from quillstat.plans import derived as D
from quillstat.plans import jobs


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _python_nodes(df) -> int:
    """Python nodes of the physical tree (its head, before the details)."""
    return len(re.findall(r"MapIn(?:Arrow|Pandas)", _plan(df).split("\n\n")[0]))


def _letters(i: int) -> str:
    return "".join(chr(97 + int(c)) for c in str(i))


@pytest.mark.parametrize("n", [0, 3, 500, 501, 4000])
def test_member_is_exact(spark, n):
    values = ["", "é", " x ", "a,b", "a\x1fb"][:n] + [f"v{i}́" for i in range(max(0, n - 5))]
    asked = [*values[::7], *values[:6], "v", "v1", "\x1f", "a", None, "V3́"]
    df = spark.createDataFrame([(a,) for a in asked], "a string")
    got = [r["m"] for r in df.select(member(F.col("a"), values).alias("m")).collect()]
    assert got == [(None if a is None else a in values) if values else False for a in asked]
    inside = df.select(F.filter(F.array("a"), lambda x: member(x, values)).alias("m")).collect()
    assert [len(r["m"]) for r in inside] == [int(a in values) for a in asked]


def test_values_are_checked_by_bytes(spark):
    df = spark.createDataFrame([("ab",), (None,), ("é",)], "v string")
    assert bounded_values(df, "v", 6) and not bounded_values(df, "v", 5) and bounded_values(df.limit(0), "v", 0)


def _many_names(spark, n):
    return spark.createDataFrame([(f"Nam{_letters(i)}", "female" if i % 2 else "male") for i in range(n)] +
                                 [("Mary", "female"), ("JOHN", "male"), ("Alex", "male"), ("alex", "female"), (None, "male"), ("Zed", "other")],
                                 "first_name string, gender string")


def test_month_job_parses_once_with_many_names(spark):
    names = _many_names(spark, 60_000)
    arts = jobs.monthly_articles(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL), names, "2013-08-01", "2014-08-01")
    assert _python_nodes(arts) == 1
    few = jobs.monthly_articles(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL), _many_names(spark, 3), "2013-08-01", "2014-08-01")
    cols = ["stories_id", "byline", "female", "male", "unknown", "full_text"]
    assert sorted(map(tuple, arts.select(cols).collect()), key=str) == sorted(map(tuple, few.select(cols).collect()), key=str)


def test_hot_byline_gives_the_same_rows_on_every_path(spark):
    names = _many_names(spark, 700)
    rows = [(i, "Mary Olt and Namb Olt" if i % 3 == 0 else [None, "", "Olt, John", "Zed Olt; Alex Olt", "Namc Olt and Zed Olt", "12"][i % 6]) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:2], "id long, byline string").repartition(6)
    forms = [sorted(map(tuple, G.byline_gender(df, names, max_inline=b).collect()), key=str) for b in (1 << 20, 100, 0)]
    assert forms[0] == forms[1] == forms[2] and len(forms[0]) == 3002
    hot = [r for r in forms[0] if r[1] == "Mary Olt and Namb Olt"]
    assert {r[2:] for r in hot} == {(2, 0, 0)} and len(hot) >= 1000
    people = spark.createDataFrame([(i, "Mary Olt" if i % 3 else "Lesley Olt") for i in range(900)] + [(900, None), (901, "Alex Olt")], "id long, person string")
    a, b = (sorted(map(tuple, G.with_gender(people, F.col("person"), G.name_lookup(names, n)).collect())) for n in (1 << 20, 0))
    assert a == b and a[1] == (1, "Mary Olt", "female")


@pytest.mark.parametrize("n", [0, 2, 499, 501, 60_000])
def test_gazetteers_of_any_size(spark, n):
    docs = spark.createDataFrame([(1, "Ada Moor met Tom Olt , and Ada Moor ."), (2, None), (3, "nobody"), (4, "Tom Olt Junior came"), (5, "Ada"), (6, ""),
                                  (7, "Naa Olt Naa Olt Olt"), (8, "Ada Ada Moor Moor"), (1, "Ada Moor")], "stories_id long, full_text string")
    listed = ["Ada Moor", "Tom Olt", "Tom Olt Junior", "Ada Moor", "Ada", None, "", " ", "Ada  Moor", " Ada", "Moor "][:n and None]
    people = spark.createDataFrame([(p,) for p in listed] + [(f"Na{_letters(i)} Olt",) for i in range(max(0, n - len(listed)))], "name string")
    want = {}
    names = {r["name"] for r in people.collect() if r["name"] and "" not in r["name"].split(" ")}
    for key, text in [tuple(r) for r in docs.collect()]:
        tok = [t for t in re.sub(r"([,.])", r" \1 ", text or "").split() if t]
        for size in (1, 2, 3):
            for i in range(len(tok) - size + 1):
                gram = " ".join(tok[i:i + size])
                if gram in names:
                    want[key, gram] = want.get((key, gram), 0) + 1
    want = sorted((*k, c) for k, c in want.items())
    for sizes in (dict(), dict(max_inline=0), dict(max_inline=0, max_broadcast=-1), dict(max_inline=0, max_starts=0), dict(max_starts=0, max_inline=0, max_broadcast=-1)):
        assert sorted(map(tuple, M.gazetteer_mentions(docs, people, **sizes).collect())) == want, sizes


def test_a_million_names_list_no_ngrams(spark):
    people = spark.range(1_000_000).select(F.concat(F.lit("First"), F.col("id") % 5000, F.lit(" Last"), F.col("id")).alias("name"))
    docs = spark.createDataFrame([(1, "Today First7 Last10007 met First8 Last7 and First7 Last10007")], "stories_id long, full_text string")
    found = M.gazetteer_mentions(docs, people)
    assert [tuple(r) for r in found.collect()] == [(1, "First7 Last10007", 2)]
    assert "BroadcastHashJoin" in _plan(found)


def test_full_text_does_not_pass_through_python(spark):
    pages = D.pages(spark, SF_SMALL).withColumn("story_text", F.when(F.col("stories_id") % 3 == 0, F.concat(F.lit("Text, of "), F.col("stories_id"))))
    arts = X.extract_metadata(D.stories(spark, SF_SMALL), pages, full_text=True)
    plan = _plan(arts)
    assert _python_nodes(arts) == 1
    for node in re.findall(r"\(\d+\) MapInArrow\nInput \[\d+\]: \[([^\n]*)\]", plan):
        assert "text" not in node and re.search(r"\bt#", node) is None
    got = {r["stories_id"]: r["full_text"] for r in arts.collect()}
    assert got[3] == "Text of 3" and got[4] and "Text of" not in got[4]


def test_two_pages_of_a_story_keep_their_own_text(spark):
    st = spark.createDataFrame([("1", 1, "http://x/y"), ("1", 2, "u"), ("1", 3, "v")], "media_id string, stories_id long, url string").withColumn(
        "publish_date", F.lit(None).cast("timestamp"))
    pages = spark.createDataFrame([(1, '<meta name="author" content="Ada Moor">one', None), (1, '<meta name="author" content="Tom Olt">two', "own text"), (2, None, "kept")],
                                  "stories_id long, html string, story_text string")
    got = [(r["stories_id"], r["byline"], r["full_text"]) for r in X.extract_metadata(st, pages, full_text=True).collect()]
    assert sorted(got, key=str) == [(1, "Ada Moor", "one"), (1, "Tom Olt", "own text"), (2, "", "kept"), (3, "", None)]
