"""Plan regression tests for the scale properties the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillstat.operators import extract as X
from quillstat.operators import sampling as S
from quillstat.plans import derived as D


def _formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _exchange_inputs(plan: str) -> list[str]:
    """The 'Input [...]' line of every shuffle / broadcast exchange node."""
    out = []
    for m in re.finditer(r"\(\d+\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan):
        out.append(m.group(1))
    return out


@pytest.fixture()
def no_auto_broadcast(spark):
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
    if old[1] is not None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old[1])


def test_html_never_reaches_an_exchange(spark, no_auto_broadcast):
    st, pg = D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL)
    for df in (X.extract_metadata(st, pg), X.legacy_extract(st, pg)):
        inputs = _exchange_inputs(_formatted(df))
        assert inputs, "expected shuffles for the story join"
        assert not any(re.search(r"\bhtml#", i) for i in inputs), inputs


def test_month_filter_prunes_the_page_scan(spark, no_auto_broadcast):
    st = S.story_scan(D.stories(spark, SF_SMALL), "2013-09-01", "2013-10-01")
    months = X.months_between("2013-09-01", "2013-10-01")
    assert months == ["2013-09"]
    plan = _formatted(X.extract_metadata(st, D.pages(spark, SF_SMALL), months=months))
    page_scan = [b for b in plan.split("\n\n") if "Scan parquet" in b and "/pages]" in b]
    assert page_scan and "publish_month" in page_scan[0].split("PartitionFilters:")[1].split("\n")[0]


def test_story_scan_pushes_filters(spark):
    st = S.story_scan(D.stories(spark, SF_SMALL), "2013-09-01", "2013-10-01", ["1", "2"])
    plan = _formatted(st)
    assert "PushedFilters: [IsNotNull(publish_date), GreaterThanOrEqual(publish_date" in plan
    assert "In(media_id" in plan and "PartitionFilters: [isnotnull(publish_month" in plan


def test_sample_is_a_top_k(spark):
    plan = _formatted(S.sample_stories(D.stories(spark, SF_SMALL), 10))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_byline_gender_inline_path_has_no_shuffle(spark):
    from quillstat.operators import gender as G
    df = G.byline_gender(D.order_bylines(spark, SF_SMALL), D.name_gender(spark))
    plan = _formatted(df.select("id", "female", "male", "unknown"))
    assert "Exchange" not in plan.split("===== Subqueries")[0] or \
        all("RoundRobinPartitioning" in ln for ln in plan.splitlines() if ln.strip().startswith("Exchange"))


@pytest.mark.parametrize("name", ["section_counts", "outlet_totals", "opinion_sections", "byline_counts", "outlet_people", "gender_rollup",
                                  "override_gender", "org_name_export", "eval_rows", "eval_accuracy", "mentioned_people", "mention_bylines"])
def test_reports_read_the_article_table(spark, name):
    from quillstat.plans import catalog
    plan = _formatted(catalog.QUERIES[name](spark, SF_SMALL))
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
