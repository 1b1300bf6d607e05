"""Extraction building blocks: selectors, byline clean-up, URL sections, accuracy (FIXTURES §6, §7, §9)."""

from pyspark.sql import functions as F

from quillstat.operators import evaluate as EV
from quillstat.operators import extract as X
from quillstat.operators import htmldom as H


def test_selector_subset():
    page = H.Page('<html><head><meta name="author" content="Ann Lee"><meta name="x"></head><body>'
                  '<p id="byline"><a href="http://www.marketwatch.com/Journalists/ann">Ann</a></p>'
                  '<div class="articleInner"><p>x<span class="byline">By  Bo Yi</span></div>'
                  '<span class="byline other">no</span><address class="c"><h4><a>Deep</a></h4></address>')
    assert page.attrs[H.select_first(page, H.parse_selector('meta[name="author"]'))]["content"] == "Ann Lee"
    i = H.select_first(page, H.parse_selector('p[id="byline"] a[href^="http://www.marketwatch.com/Journalists/"]'))
    assert page.text(i) == "Ann"
    i = H.select_first(page, H.parse_selector('div[class="articleInner"] span[class="byline"]'))
    assert page.text(i) == "By  Bo Yi"  # unclosed <p> does not hide the descendant
    assert page.text(H.select_first(page, H.parse_selector('address[class="c"] h4 a'))) == "Deep"
    # [class="x"] compares the whole attribute; find() also accepts one of the classes
    assert H.select_first(page, H.parse_selector('span[class="other"]')) == -1
    assert page.text(H.find_first(page, "span", "class", "other")) == "no"
    assert H.select_first(page, H.parse_selector('meta[name="missing"]')) == -1


def test_missing_attribute_fails_the_story():
    page = H.Page('<meta name="author">')
    compiled = X._compile({"o": [(1, 'meta[name="author"]', "content", None, 0)]})["o"]
    try:
        X._first_hit(page, compiled)
        raised = False
    except KeyError:
        raised = True
    assert raised


def test_clean_byline(spark):
    rows = [("By JULES CARTER", "JULES CARTER"), ("BY  ANN LEE\n", "ANN LEE"), ("\n  By Ann Lee", "By Ann Lee"),
            ("by: Ann Lee", "by: Ann Lee"), ("bY Ann Lee", "bY Ann Lee"), ("   ", ""), ("By ", "By")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "v string")
    got = [r.c for r in df.select(X.clean_byline("v").alias("c")).collect()]
    assert got == [b for _, b in rows]


def test_section_from_url(spark):
    rows = [
        ("nyt", "http://www.nytimes.com/2013/05/10/us/politics/benghazi-debate.html?partner=rss", "us/politics"),
        ("nyt", "http://www.nytimes.com/aponline/2013/01/27/sports/ncaabasketball/ap.html", None),
        ("nyt", "http://www.nytimes.com/2013/11/02/opinion/a-title.html", "opinion"),
        ("nypost", "http://www.nypost.com/p/sports/tennis/federer_v4x2?CMP=OTC-rss&FEEDNAME=", "sports"),
        ("nypost", "http://www.nypost.com/p/sports/horse_racing/monticello?utm_medium=rss&utm_content=H", None),
        ("wapo", "http://feeds.washingtonpost.com/c/34656/f/636708/s/2ecedd6a/l/"
                 "0L0Swashingtonpost0N0Copinions0Cabc0Edef/story01.htm", "opinion"),
        ("wapo", "http://www.washingtonpost.com/wp-dyn/content/article/2010/05/06/AR2010050600001.html"
                 "?nav=rss_opinions", None),
        ("lat", "http://feeds.latimes.com/~r/latimes/news/opinion/~3/abc/", "news/opinion"),
        ("lat", "http://feeds.latimes.com/~r/OpinionLa/~3/abc/", "OpinionLa"),
        ("dailybeast", "http://feedproxy.google.com/~r/thedailybeast/articles/~3/x/", "articles"),
    ]
    df = spark.createDataFrame([(o, u) for o, u, _ in rows], "outlet string, url string")
    got = [r.s for r in df.select(X.section_from_url("outlet", "url").alias("s")).collect()]
    assert got == [s for _, _, s in rows]


def test_is_opinion_modes(spark):
    df = spark.createDataFrame([("nyt", "opinion"), ("nyt", "Opinion"), ("nyt", ""), ("wsj", "opinion"),
                                ("lat", "OpinionLa"), ("nyt", "sports")], "outlet string, section string")
    r = df.select(X.is_opinion("outlet", "section").alias("a"),
                  X.is_opinion("outlet", "section", compat=True).alias("b")).collect()
    assert [x.a for x in r] == [True, True, None, None, True, False]
    assert [x.b for x in r] == [False, False, None, None, False, False]


def test_accuracy_tally(spark):
    rows = [("y", "anything", "other"), ("n", "Ann Lee ", "ann lee"), ("n", "Ann", "Ann Lee"),
            ("n", "Ann", ""), ("n", "", "")]
    df = spark.createDataFrame(rows, "correct string, extracted_byline string, actual_byline string")
    r = EV.accuracy(df).first()
    assert (r.n_correct, r.n_incorrect, r.accuracy) == (3, 1, 0.75)
    empty = EV.accuracy(df.limit(0)).first()
    assert empty.accuracy is None


def test_extra_and_missing_text(spark):
    df = spark.createDataFrame([("By Ann Lee and Ann Lee, Staff", "ann lee"), ("Bo", "Ann Lee;;Bo Yi")],
                               "x string, a string")
    r = df.select(EV.extra_text(F.col("x"), F.col("a")).alias("e"),
                  EV.missing_text(F.col("x"), F.col("a")).alias("m")).collect()
    assert r[0].e == "by ann lee and ;, staff"
    assert r[1].e is None and r[1].m == "Ann Lee;;;Bo Yi;;;"


def test_wapo_query_string_fix_is_opt_in(spark):
    from quillstat.sources import rules
    url = "http://www.washingtonpost.com/wp-dyn/content/article/2010/05/06/AR2010050600001.html?nav=rss_opinions"
    df = spark.createDataFrame([("wapo", url)], "outlet string, url string")
    plain = df.select(X.section_from_url("outlet", "url").alias("s")).first().s
    fixed = df.select(X.section_from_url("outlet", "url", rules.extractor_rules(spark, fix_url_rules=True))
                      .alias("s")).first().s
    assert plain is None and fixed == "opinions"


def test_native_ascii_fold_equals_nfkd(spark):
    from quillstat.functions import text as TX
    samples = ["Éric Ñúñez", "ﬁne ½ ① Ⅻ ㈠", "Straße ÆØÅ", "\U0001D400\U0001F100x", "", None, "plain",
               "Zoë Brontë-O'Neil", "ǅ ǈ ǋ", "⁵⁄₈ ㎏ ℡"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(samples)], "i int, v string")
    got = df.select("i", TX.ascii_fold_native("v").alias("a"), TX.ascii_fold("v").alias("b")).collect()
    assert all(r.a == r.b for r in got), [(samples[r.i], r.a, r.b) for r in got if r.a != r.b]


def test_months_between():
    assert X.months_between("2013-08-01", "2013-09-01") == ["2013-08"]
    assert X.months_between("2013-08-01", "2013-09-01", closed=True) == ["2013-08", "2013-09"]
    assert X.months_between("2013-11-15", "2014-02-01") == ["2013-11", "2013-12", "2014-01"]
    assert X.months_between("2013-12-01", "2014-01-15") == ["2013-12", "2014-01"]
