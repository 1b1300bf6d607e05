"""Readers and writers: CSV sheets, legacy rule file, stored pages, run log, routing."""

import os
import tempfile

from pyspark.sql import functions as F

from quillstat.operators import extract as X
from quillstat.sources import readers, rules, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="quillstat-test-", dir="/tmp")


def test_legacy_rule_file_cr_and_tab(spark):
    d = _tmp()
    p = os.path.join(d, "rules.csv")
    with open(p, "w", newline="") as f:
        f.write("media_id,tag,attr,attr\r1757,span,class,byline\r1104,meta,name,author\t\r1,meta,name,author")
    df = readers.read_legacy_rules(spark, p).orderBy("priority").collect()
    assert [(r.media_id, r.tag, r.attr, r.value) for r in df] == [
        ("1757", "span", "class", "byline"), ("1104", "meta", "name", "author"), ("1", "meta", "name", "author")]


def test_override_sheet_and_last_row_wins(spark):
    from quillstat.operators import gender as G
    d = _tmp()
    p = os.path.join(d, "sheet.csv")
    with open(p, "w") as f:
        f.write("org,name,x,count,gender\n"
                "new+york+times,ann+lee,,3,female\n"
                "new+york+times,ann+lee,,4,Female\n"
                "new+york+times,bo+yi,,1,male\n"
                "new+york+times,bo+yi,,2,unknown\n")
    sheet = readers.read_override_sheet(spark, p)
    assert sheet.count() == 4
    clean = {(r.org, r.name): (r.gender, r["count"]) for r in G.clean_overrides(sheet).collect()}
    assert clean == {("new york times", "ann lee"): ("female", 3), ("new york times", "bo yi"): ("unknown", 2)}
    assert G.override_rejects(sheet).count() == 1


def test_eval_labels_skip_two_headers(spark):
    d = _tmp()
    p = os.path.join(d, "labels.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e,f,g,h,i\nA,B,C,D,E,F,G,H,I\n1,5,u,,Ann Lee,y,,,1\n2,6,v,,\"Lee, Ann\",n,Ann Lee,,2\n")
    rows = readers.read_eval_labels(spark, p).orderBy("row_no").collect()
    assert [(r.media_id, r.stories_id, r.byline_extracted_label, r.is_correct) for r in rows] == [
        ("1", 5, "Ann Lee", "y"), ("2", 6, "Lee, Ann", "n")]
    assert [r.byline_corrected for r in rows] == ["", "Ann Lee"]  # an empty cell is an empty text


def test_stored_pages(spark):
    d = _tmp()
    for sid, html in ((11, "<p>a</p>"), (12, "<p>b\nc</p>")):
        with open(os.path.join(d, f"{sid}.html"), "w") as f:
            f.write(html)
    got = {r.stories_id: r.html for r in readers.read_page_files(spark, d).collect()}
    assert got == {11: "<p>a</p>", 12: "<p>b\nc</p>"}
    out = os.path.join(d, "by-id")
    spark.createDataFrame([(11, "<p>a</p>"), (12, "<p>b\nc</p>")], "stories_id long, html string").write.partitionBy("stories_id").text(out)
    assert {r.stories_id: r.html for r in readers.read_page_files(spark, out).collect()} == {k: f"{v}\n" for k, v in got.items()}


def test_run_log_appends(spark):
    d = os.path.join(_tmp(), "log")
    sinks.append_run_log(spark, d, "run-a")
    sinks.append_run_log(spark, d, "run-b")
    lines = [r.value for r in spark.read.text(d).collect()]
    assert sorted(x.split(": ")[1] for x in lines) == ["run-a", "run-b"]


def test_routing_covers_every_story(spark):
    st = spark.createDataFrame([("1", 1, "u1"), ("1", 2, "u2"), ("99", 3, "u3")],
                               "media_id string, stories_id long, url string")
    pg = spark.createDataFrame([(1, '<meta name="author" content="Ann">'), (2, "<p>x</p>"), (3, "<p>y</p>")],
                               "stories_id long, html string")
    leg = X.legacy_extract(st, pg)
    found, failed = X.route(leg)
    assert [(r.stories_id, r.foundwith, r.byline) for r in found.collect()] == [(1, "meta[name=author]", "Ann")]
    assert sorted((r.stories_id, r.reason) for r in failed.collect()) == [(2, "Included not found"),
                                                                         (3, "Not included")]
    d = _tmp()
    sinks.write_routed(leg, os.path.join(d, "found"), os.path.join(d, "failed"))
    assert spark.read.option("header", True).csv(os.path.join(d, "failed")).count() == 2


def test_rule_tables_shape(spark):
    r = rules.extractor_rules(spark)
    assert r.where(F.col("kind") == "byline").count() == len(rules.BYLINE_RULES)
    assert rules.legacy_rules(spark).count() == 47
    assert rules.media(spark).select("media_name").distinct().count() == 9


def test_closed_and_half_open_month(spark):
    from quillstat.operators import sampling as S
    df = spark.createDataFrame([(1, "2013-09-01 00:00:00"), (2, "2013-09-15 00:00:00"), (3, "2013-10-01 00:00:00")],
                               "stories_id long, d string").withColumn("publish_date", F.to_timestamp("d"))
    half = sorted(r.stories_id for r in S.story_scan(df, "2013-09-01", "2013-10-01").collect())
    closed = sorted(r.stories_id for r in S.story_scan(df, "2013-09-01", "2013-10-01", closed=True).collect())
    assert half == [1, 2] and closed == [1, 2, 3]


def test_unmatched_media(spark):
    from quillstat.operators import reports as RP
    st = spark.createDataFrame([("1", 1), ("424242", 2)], "media_id string, stories_id long")
    assert [r.stories_id for r in RP.unmatched_media(st, rules.media(spark)).collect()] == [2]


def test_story_list_and_article_sinks(spark):
    d = _tmp()
    p = os.path.join(d, "list.csv")
    with open(p, "w") as f:
        f.write("media_id,publish_date,stories_id,url,file_name\n1,2013-08-01,7,http://x,./a/7.html\n")
    r = readers.read_story_list(spark, p).first()
    assert (r.media_id, r.stories_id, r.file_name) == ("1", 7, "./a/7.html")
    arts = spark.createDataFrame(
        [("1", 7, "2013-08-01 00:00:00", "http://x", "Ann Lee", 1, 0, 0, "opinion", True, None),
         ("1", 8, "2013-09-02 00:00:00", "http://y", None, None, None, None, None, None, None)],
        "media_id string, stories_id long, publish_date string, url string, byline string, female int, "
        "male int, unknown int, section string, is_opinion boolean, full_text string"
    ).withColumn("publish_date", F.to_timestamp("publish_date"))
    sinks.write_articles(arts, os.path.join(d, "pq"))
    back = spark.read.parquet(os.path.join(d, "pq"))
    assert sorted(r.publish_month for r in back.select("publish_month").distinct().collect()) == ["2013-08", "2013-09"]
    sinks.write_articles(arts, os.path.join(d, "csv"), fmt="csv")
    m = readers.read_month_files(spark, [os.path.join(d, "csv", "publish_month=2013-08"),
                                         os.path.join(d, "csv", "publish_month=2013-09")])
    got = {r.stories_id: (r.byline, r.is_opinion) for r in m.collect()}
    assert got == {7: ("Ann Lee", True), 8: (None, None)}
    sinks.write_run_results(arts.select("stories_id", "byline"), arts.select("stories_id"), os.path.join(d, "runs"),
                            "r1")
    assert spark.read.parquet(os.path.join(d, "runs", "extracted_results")).where("run_id = 'r1'").count() == 2


def test_stories_from_sentences(spark):
    s = spark.createDataFrame([("1", 5, 1, "2013-08-01 00:00:00", "u"), ("1", 5, 2, "2013-08-01 00:00:00", "u")],
                              "media_id string, stories_id long, sentence_number int, publish_date string, url string")
    assert readers.stories_from_sentences(s).count() == 1


def test_saved_run_files(spark):
    d = _tmp()
    with open(os.path.join(d, "found.csv"), "w") as f:
        f.write('9,http://a,1,meta[name=dc.creator],\n'
                '1,http://b,2,meta[name=author],ANN LEE\n'
                '7,http://c,3,meta[name=parsely-page],"{""title"": ""T"",\n'
                '                ""author"": ""By BO YI""\n'
                '               }"\n')
    with open(os.path.join(d, "failed.csv"), "w") as f:
        f.write("1,http://d,4,Included not found\n1,http://e,5,<type 'exceptions.Exception'>\n")
    routed = readers.read_routed_results(spark, os.path.join(d, "found.csv"), os.path.join(d, "failed.csv"))
    rows = {r.stories_id: r for r in routed.collect()}
    assert rows[1].byline is None or rows[1].byline == ""
    assert '"author": "By BO YI"' in rows[3].byline and "\n" in rows[3].byline
    assert rows[5].status == "<type 'exceptions.Exception'>"
    r = readers.found_rate(routed).first()
    assert (r.n_found, r.n_stories, r.rate) == (3, 5, 0.6)


def test_read_stories_keeps_month_partition(spark):
    d = _tmp()
    df = spark.createDataFrame([("1", 1, "2013-08-01 00:00:00", "u", "2013-08")],
                               "media_id string, stories_id long, publish_date string, url string, publish_month string")
    df.withColumn("publish_date", F.to_timestamp("publish_date")).write.partitionBy("publish_month").parquet(d + "/s")
    st = readers.read_stories(spark, d + "/s")
    assert st.columns == ["media_id", "stories_id", "publish_date", "url", "publish_month"]
    assert st.first().publish_month == "2013-08"
