"""Rule, media and label tables.

Extraction rules are data: one row per rule with an explicit priority. The
lists below are the fixed values the results depend on; they are kept as
plain text in their natural (priority) order. Each table is a few dozen rows,
so it is built as a local DataFrame and joined with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: media ids, outlet names and outlet extractor keys.
# Two ids (314, 27502) are one outlet.
# ---------------------------------------------------------------------------
MEDIA = [
    ("1", "new york times", "nyt"),
    ("2", "washington post", "wapo"),
    ("6", "la times", "lat"),
    ("7", "new york post", "nypost"),
    ("1150", "wall street journal", "wsj"),
    ("1757", "salon", "salon"),
    ("1707", "daily beast", "dailybeast"),
    ("1750", "telegraph", "telegraph"),
    ("314", "huffington post", "huffpo"),
    ("27502", "huffington post", "huffpo"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: byline rules per outlet, in priority order.
# (outlet, selector, attribute or None for element text, regex or None, group)
# Regexes are anchored with ^ (the rules match at the start of the value) and name their
# capture by position (Spark's regexp_extract takes a group index).
# ---------------------------------------------------------------------------
_BY_NAME = r"^By ([A-Za-z\.\- ]*)"
_BY_SPACES_NAME = r"^By[\s]+([A-Za-z\.\- ]*)"
_LAT_CONTACT = r"^([A-Za-z. -]+) contact the reporter"
_LAT_DATED = r"^((January|February|March|April|June|July|August|September|October|November|December)( \d\d?, \d\d\d\d\|)(By )?)([A-Z]{1}[A-Za-z. -]+)($|, Los Angeles Times)"  # noqa: E501

BYLINE_RULES = [
    ("nyt", 'meta[name="author"]', "content", None, 0),
    ("nyt", 'meta[name="byl"]', "content", _BY_NAME, 1),
    ("nyt", 'meta[name="CLMST"]', "content", _BY_SPACES_NAME, 1),
    ("nyt", 'span[class="byline-author"]', None, None, 0),
    ("nyt", 'p[class="byline"]', None, None, 0),
    ("nyt", 'h6[class="byline"]', None, _BY_SPACES_NAME, 1),
    ("wapo", 'meta[name="authors"]', "content", None, 0),
    ("wapo", 'meta[name="dc.creator"]', "content", None, 0),
    ("wapo", 'meta[name="DC.creator"]', "content", None, 0),
    ("wapo", 'span[class="blog-byline"]', None, None, 0),
    ("wapo", 'div[id="byline"]', None, None, 0),
    ("wapo", 'p[class="posted"]', None, None, 0),
    ("wapo", 'span[class="pb-byline"]', None, None, 0),
    ("wsj", 'meta[name="article.author"]', "content", None, 0),
    ("wsj", 'meta[name="author"]', "content", None, 0),
    ("wsj", 'h3[class="byline"]', None, None, 0),
    ("wsj", 'span[id="byline"]', None, None, 0),
    ("wsj", 'p[id="byline"] a[href^="http://www.marketwatch.com/Journalists/"]', None, None, 0),
    ("wsj", 'p[class="emphasis"] span[class="credit"]', None, None, 0),
    ("lat", 'span[class="byline"]', None, None, 0),
    ("lat", 'div[class="trb_bylines"]', None, _LAT_CONTACT, 1),
    ("lat", 'address[class="trb_columnistInfo_columnistPortrait"]', None, None, 0),
    ("lat", 'div[id="mod-article-byline"]', None, _LAT_DATED, 5),
    ("lat", 'div[class="byline"]', None, None, 0),
    ("lat", 'span[class="byline"]', None, None, 0),
    ("lat", 'address[class="trb_columnistInfo_contactInfo"] h4 a', None, None, 0),
    ("huffpo", 'a[rel="author"]', None, None, 0),
    ("huffpo", 'meta[name="author"]', "content", None, 0),
    ("salon", 'div[class="articleInner"] span[class="byline"]', None, _BY_SPACES_NAME, 1),
    ("salon", 'a[rel="author"]', None, None, 0),
    ("dailybeast", 'meta[name="authors"]', "content", None, 0),
    ("dailybeast", 'a[class="more-by-author"]', None, None, 0),
    ("dailybeast", 'div[class="author1"]', None, None, 0),
    ("yale", 'div[class="entry-authors"]', None, None, 0),
    ("princeton", 'p[class="byline"]', None, None, 0),
    ("columbia", 'div[class="article-authors"]', None, None, 0),
    ("telegraph", 'meta[name="DCSext.author"]', "content", None, 0),
    ("nypost", 'div[id="author-byline"]', None, None, 0),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: section rules from the URL, in priority order.
# (outlet, regex anchored at start, group)
# ---------------------------------------------------------------------------
SECTION_URL_RULES = [
    ("nyt", r"^http://www.nytimes.com/[0-9]{4}/[0-9]{2}/[0-9]{2}/([A-Za-z0-9/]+)/", 1),
    ("wapo", r"^http://feeds.washingtonpost.com/c/34656/f/[0-9]+/s/[A-Za-z0-9]+/(sc/[0-9]+/l|l)/0L0Swashingtonpost0N0C([A-Za-z0-9]+?)s0C[A-Za-z0-9]+/story01.htm", 2),  # noqa: E501
    ("wapo", r"^http://www.washingtonpost.com/wp-dyn/content/article/[0-9]{4}/[0-9]{2}/[0-9]{2}/AR[0-9]+.html?(nav|wprss)=rss_([A-Za-z0-9]+)(/columns$|/industries$|s$|$)", 2),  # noqa: E501
    ("lat", r"^http://feeds.latimes.com/~r/(latimes/)*([A-Za-z/]+)/~3", 2),
    ("dailybeast", r"^http://(www.thedailybeast.com/|feedproxy.google.com/~r/thedailybeast/)([A-Za-z\-]+)/[\S]*", 2),  # noqa: E501
    ("nypost", r"^http://www.nypost.com/p/([A-Za-z0-9\-\\]+)/[\S]*rss&FEEDNAME=", 1),
]

# Added rule (not in the source data), used only with ``fix_url_rules=True``: the second WaPo
# pattern with its query-string '?' escaped, so real "...html?nav=rss_x" URLs can match (D-6).
SECTION_URL_ADDED = [
    ("wapo", r"^http://www.washingtonpost.com/wp-dyn/content/article/[0-9]{4}/[0-9]{2}/[0-9]{2}/AR[0-9]+\.html\?(nav|wprss)=rss_([A-Za-z0-9]+)(/columns$|/industries$|s$|$)", 2),  # noqa: E501
]

# ---------------------------------------------------------------------------
# FIXED VALUES: section rules from page tags, in priority order.
# (outlet, selector, attribute or None for element text)
# ---------------------------------------------------------------------------
SECTION_TAG_RULES = [
    ("nyt", 'meta[name="CG"]', "content"),
    ("nyt", 'meta[name="SCG"]', "content"),
    ("nyt", 'meta[itemprop="articleSection"]', "content"),
    ("nyt", 'meta[name="PT"]', "content"),
    ("nyt", 'meta[name="tom"]', "content"),
    ("nyt", 'meta[name="PST"]', "content"),
    ("nyt", 'meta[name="BN"]', "content"),
    ("wapo", 'meta[name="section"]', "content"),
    ("wsj", 'meta[name="article.section"]', "content"),
    ("lat", 'meta[name="article.section"]', "content"),
    ("telegraph", 'meta[name="DCSext.cmsSect"]', "content"),
    ("telegraph", 'meta[name="DCSext.Channel"]', "content"),
    ("nypost", 'meta[name="nypost-section"]', "content"),
    ("nypost", 'p[class="section-tag"] a[class="background-color"]', None),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: opinion section labels per outlet.
# ---------------------------------------------------------------------------
OPINION_LABELS = [
    ("nyt", "opinion"),
    ("wapo", "opinion"),
    ("wapo", "blog"),
    ("lat", "news/opinion"),
    ("lat", "OpinionLa"),
    ("telegraph", "Comment"),
    ("telegraph", "Personal_View"),
    ("nypost", "opinion"),
    ("nypost", "opinions"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: legacy rule table, file order = priority.
# (media_id, tag, attribute name, attribute value); one trailing tab trimmed.
# ---------------------------------------------------------------------------
LEGACY_RULES = [
    ("1757", "span", "class", "byline"),
    ("1150", "meta", "name", "author"),
    ("6", "span", "class", "byline"),
    ("4418", "a", "rel", "author"),
    ("4418", "a", "class", "author-block__name"),
    ("4414", "span", "class", "author"),
    ("1752", "p", "class", "pagiAuthor"),
    ("1751", "a", "rel", "author"),
    ("1094", "span", "class", "byline"),
    ("1149", "meta", "name", "author"),
    ("1747", "a", "class", "author"),
    ("1751", "meta", "name", "author"),
    ("1", "meta", "name", "author"),
    ("8", "a", "rel", "author"),
    ("1750", "a", "rel", "author"),
    ("1092", "span", "itemprop", "name"),
    ("1104", "meta", "name", "author"),
    ("314", "meta", "name", "author"),
    ("7", "p", "class", "byline"),
    ("1752", "div", "class", "byline"),
    ("4419", "a", "itemprop", "author"),
    ("2", "span", "class", "blog-byline"),
    ("1095", "meta", "name", "author"),
    ("4415", "a", "rel", "author"),
    ("4", "span", "itemprop", "name"),
    ("6", "meta", "name", "author"),
    ("1", "span", "class", "byline-author"),
    ("4418", "a", "class", "author-name"),
    ("1104", "meta", "name", "author"),
    ("14", "a", "class", "email fn"),
    ("14", "meta", "name", "author.name"),
    ("1089", "p", "class", "byline"),
    ("1751", "span", "rel", "author"),
    ("1752", "div", "class", "storyBlogByline"),
    ("7", "meta", "name", "byline"),
    ("4418", "h3", "property", "foaf:name"),
    ("4418", "div", "class", "author-description clearfix"),
    ("1094", "span", "class", "byline-name"),
    ("1098", "a", "rel", "author"),
    ("4418", "a", "rel", "author"),
    ("8", "h3", "class", "byline"),
    ("1", "meta", "name", "clmst"),
    ("1092", "meta", "name", "dc.creator"),
    ("8", "p", "class", "entry_author"),
    ("6", "div", "id", "mod-article-byline"),
    ("2", "meta", "name", "dc.creator"),
    ("2", "meta", "name", "DC.creator"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: gender labels accepted from the manual override sheet.
# ---------------------------------------------------------------------------
OVERRIDE_LABELS = ["male", "female", "unknown", "ignore"]


RULE_SCHEMA = T.StructType([
    T.StructField("outlet", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("selector", T.StringType(), True),
    T.StructField("attr", T.StringType(), True),
    T.StructField("regex", T.StringType(), True),
    T.StructField("grp", T.IntegerType(), False),
])


def extractor_rule_rows(fix_url_rules: bool = False) -> list[tuple]:
    """All rules as rows; priority counts from 1 within (outlet, kind). ``fix_url_rules``
    appends the added URL rules after each outlet's own."""
    rows: list[tuple] = []
    seen: dict[tuple, int] = {}

    def nxt(outlet, kind):
        seen[(outlet, kind)] = seen.get((outlet, kind), 0) + 1
        return seen[(outlet, kind)]

    for outlet, sel, attr, rx, grp in BYLINE_RULES:
        rows.append((outlet, "byline", nxt(outlet, "byline"), sel, attr, rx, grp))
    url_rules = SECTION_URL_RULES + (SECTION_URL_ADDED if fix_url_rules else [])
    for outlet, rx, grp in url_rules:
        rows.append((outlet, "section_url", nxt(outlet, "section_url"), None, None, rx, grp))
    for outlet, sel, attr in SECTION_TAG_RULES:
        rows.append((outlet, "section_tag", nxt(outlet, "section_tag"), sel, attr, None, 0))
    return rows


def extractor_rules(spark: SparkSession, fix_url_rules: bool = False) -> DataFrame:
    return spark.createDataFrame(extractor_rule_rows(fix_url_rules), RULE_SCHEMA)


def media(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEDIA, "media_id string, media_name string, outlet string")


def opinion_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OPINION_LABELS, "outlet string, label string")


def legacy_rule_rows() -> list[tuple]:
    return [(m, tag, attr, val.strip(), i + 1) for i, (m, tag, attr, val) in enumerate(LEGACY_RULES)]


def legacy_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        legacy_rule_rows(), "media_id string, tag string, attr string, value string, priority int")
