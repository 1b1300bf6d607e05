"""Every registered query against its DuckDB oracle (the driver's gate), on sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle import compare, duck
from quillstat.plans import catalog

QUERIES = {name: fn for name, fn in E.queries().items() if name in catalog.QUERIES}  # the optional parts have their own tests
ORACLES = {name: sql for name, sql in E.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(QUERIES[name](spark, SF_SMALL), ORACLES[name], con)
    assert r["ok"], {k: v for k, v in r.items() if k != "spark_cols"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"byline", "section", "is_opinion", "female", "male", "unknown"} <= set(df.columns)
