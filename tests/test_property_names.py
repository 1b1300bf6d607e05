"""Property check: the Spark name functions and their DuckDB SQL forms agree on random bylines
built from delimiter/title/initial tokens (two regex engines, two evaluation paths)."""

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstat.functions import names as N
from quillstat.plans import duck as Q

TOKENS = ["Ann", "lee", "Bo", "Yi", "J.", "J", "By", "BY", "by", " ", "  ", ",", ";", " and ", "Jr.", "prof",
          "sir", "Dr", "dr ", "2013", "of", " in ", " for ", "\t", "é", "O'Neil", "-", "| ", "graphics by: ",
          "as told to ", " at", "rt revd", "more stories by ", ".", "based", "\n", "Staff Writer"]

byline = st.lists(st.sampled_from(TOKENS), min_size=0, max_size=9).map("".join)


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(byline, min_size=40, max_size=80))
def test_names_spark_equals_duckdb(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: (r.f, r.p) for r in df.select(
        "i", N.join_names(N.first_names("s")).alias("f"), N.join_names(N.full_names("s")).alias("p")).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "s"])  # noqa: F841 (read by DuckDB by name)
    con = duckdb.connect()
    sql = f"SELECT i, {Q.join_names(Q.first_names('s'))} AS f, {Q.join_names(Q.full_names('s'))} AS p FROM pdf"
    want = {i: (f, p) for i, f, p in con.sql(sql).fetchall()}
    bad = {i: (values[i], got[i], want[i]) for i in got if got[i] != want[i]}
    assert not bad, bad
