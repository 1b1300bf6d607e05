"""End-to-end flows on the sf0.001 derived inputs."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillstat.operators import gender as G
from quillstat.operators import mentions as M
from quillstat.operators import extract as X
from quillstat.plans import derived as D
from quillstat.plans import jobs


def _tmp():
    return tempfile.mkdtemp(prefix="quillstat-jobs-", dir="/tmp")


def test_monthly_and_report(spark):
    out = _tmp()
    arts = jobs.monthly_articles(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL), D.name_gender(spark),
                                 "2013-08-01", "2013-09-01", out_path=os.path.join(out, "m"))
    n = arts.count()
    assert n == D.stories(spark, SF_SMALL).where(F.col("publish_date") < "2013-09-01").count()
    assert spark.read.option("header", True).csv(os.path.join(out, "m")).count() == n
    txt = D.pages(spark, SF_SMALL).select("stories_id", X.full_text_col(F.lit(None).cast("string"), F.col("html"))
                                          .alias("full_text"))
    mentions = M.gazetteer_mentions(txt, D.gazetteer(spark))
    rep = jobs.outlet_report(arts, mentions, G.name_lookup(D.name_gender(spark)))
    sec = rep["section_counts"].agg(F.sum("n_articles")).first()[0]
    tot = rep["outlet_totals"].agg(F.sum("n_articles")).first()[0]
    assert sec == tot == n  # A-1 sums to A-2
    assert rep["mentioned_people"].count() >= 0


def test_evaluation_run(spark):
    out = _tmp()
    acc = jobs.evaluation_run(spark, D.eval_labels(spark, SF_SMALL), D.stories(spark, SF_SMALL),
                              D.pages(spark, SF_SMALL), D.name_gender(spark), out, "r1").first()
    assert acc.n_correct + acc.n_incorrect > 0
    assert spark.read.text(os.path.join(out, "run_log")).count() == 1


def test_legacy_sample_run(spark):
    out = _tmp()
    summary = jobs.legacy_sample_run(spark, D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL),
                                     "2013-08-01", "2014-08-01", D.media_set(spark), 20, out, "r1")
    assert summary.agg(F.sum("n_stories")).first()[0] == 20  # found + failed = sample
    found = spark.read.option("header", True).csv(os.path.join(out, "r1", "extracted_bylines")).count()
    failed = spark.read.option("header", True).csv(os.path.join(out, "r1", "failed_bylines")).count()
    assert found + failed == 20


def test_file_mode(spark):
    d = _tmp()
    pages_dir = os.path.join(d, "pages")
    os.makedirs(pages_dir)
    with open(os.path.join(pages_dir, "1.html"), "w") as f:
        f.write('<html><head><meta name="author" content="Ann Lee"></head><body></body></html>')
    with open(os.path.join(pages_dir, "2.html"), "w") as f:
        f.write('<html><head><meta name="author"></head><body></body></html>')  # fails: no content
    lst = os.path.join(d, "list.csv")
    with open(lst, "w") as f:
        f.write("media_id,publish_date,stories_id,url,file_name\n"
                "1,2013-08-01,1,http://a,pages/1.html\n1,2013-08-01,2,http://b,pages/2.html\n"
                "1,2013-08-01,3,http://c,pages/3.html\n")
    archive = spark.createDataFrame([(2, '<meta name="author" content="Bo Yi">')], "stories_id long, html string")
    got = {r.stories_id: r.byline for r in jobs.file_mode(spark, lst, pages_dir, archive,
                                                           D.name_gender(spark)).collect()}
    assert got == {1: "Ann Lee", 2: "Bo Yi"}  # story 3: no file, no archived page → dropped


def test_people_fan_out_invariant(spark):
    """A-4 counts every person of every opinion byline once: the sum of counts equals the
    total length of the people arrays of the opinion articles."""
    from quillstat.functions import names as N
    from quillstat.operators import reports as RP
    arts = X.extract_metadata(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL))
    total = RP.byline_counts(arts).agg(F.sum("n_articles")).first()[0] or 0
    direct = (arts.where(RP.opinion_filter("section"))
              .select(F.size(N.full_names(F.col("byline"))).alias("k")).agg(F.sum("k")).first()[0] or 0)
    assert total == direct
