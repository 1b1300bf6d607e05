"""Registered queries (Spark) and their DuckDB oracles.

Each query takes (spark, sf_dir), reads the driver tables (through the derived
projections of ``plans.derived``) and returns a DataFrame over the WHOLE input.
The matching oracle is independent SQL for DuckDB over the same parquet views:
the derived inputs share their SQL text, the operator under test does not.
Column names match on both sides; arrays are returned as '|'-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.functions import names as N
from quillstat.functions import text as TX
from quillstat.operators import evaluate as E
from quillstat.operators import extract as X
from quillstat.operators import gender as G
from quillstat.operators import mentions as M
from quillstat.operators import reports as RP
from quillstat.operators import rollups as RU
from quillstat.operators import sampling as S
from quillstat.plans import derived as D
from quillstat.plans import duck as Q
from quillstat.sources import rules as R
from quillstat.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


_MEMO: dict[tuple, object] = {}


def _memo(spark, key: str, build):
    """Small per-application constants (name sets, gazetteer list): built once."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def _sets(spark):
    return _memo(spark, "name_sets", lambda: G.name_lookup(D.name_gender(spark)))


def articles(spark: SparkSession, sf: str, full_text: bool = False) -> DataFrame:
    """Extracted articles with byline gender counts (null for failed stories)."""
    a = X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf), full_text=full_text)
    a = G.byline_gender(a, D.name_gender(spark), key_cols=["stories_id"], sets=_sets(spark))
    ok = F.col("status") == "ok"
    return (a.withColumn("female", F.when(ok, F.col("female")))
            .withColumn("male", F.when(ok, F.col("male")))
            .withColumn("unknown", F.when(ok, F.col("unknown"))))


def _stored(spark, sf: str, name: str, build) -> DataFrame:
    """A table written once per application and input to the shared folder, then read."""
    def write():
        path = _scratch(spark, name)
        df = build()
        df.write.parquet(path)
        return path, df.schema
    path, schema = _memo(spark, f"{name} {sf.rstrip('/')}", write)
    return spark.read.schema(schema).parquet(path)


def article_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored article table: pages are parsed once, every report reads this."""
    return _stored(spark, sf, "articles", lambda: articles(spark, sf))


def mention_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored (stories_id, name, count) of people mentioned."""
    return _stored(spark, sf, "mentions", lambda: _mentions(spark, sf))


# --- DuckDB building blocks ------------------------------------------------------

def _fem_male():
    fem = [n for n, g in D.NAME_GENDER if g == "female"]
    mal = [n for n, g in D.NAME_GENDER if g == "male"]
    return "[" + ", ".join(D.q(x) for x in fem) + "]", "[" + ", ".join(D.q(x) for x in mal) + "]"


def q_gender_counts(arr: str) -> tuple[str, str, str]:
    fem, mal = _fem_male()
    f = f"CAST(len(list_filter({arr}, lambda g1: list_contains({fem}, lower(g1)))) AS INTEGER)"
    m = f"CAST(len(list_filter({arr}, lambda g2: list_contains({mal}, lower(g2)))) AS INTEGER)"
    return f, m, f"CAST(len({arr}) - {f} - {m} AS INTEGER)"


def q_guess(first: str) -> str:
    fem, mal = _fem_male()
    return (f"(CASE WHEN {first} IS NULL THEN 'unknown' WHEN list_contains({fem}, lower({first})) THEN 'female' "
            f"WHEN list_contains({mal}, lower({first})) THEN 'male' ELSE 'unknown' END)")


def q_single_gender(name: str) -> str:
    s = Q.strip_ws(name)
    first = f"({Q.first_names(s)})[1]"
    return f"(CASE WHEN {name} IS NULL OR length({s}) = 0 THEN 'unknown' ELSE {q_guess(first)} END)"


def q_articles() -> str:
    fn = Q.first_names("byline")
    f, m, u = q_gender_counts(fn)
    ok = "status = 'ok'"
    return (f"(SELECT *, CASE WHEN {ok} THEN {f} END AS female, CASE WHEN {ok} THEN {m} END AS male, "
            f"CASE WHEN {ok} THEN {u} END AS unknown FROM {Q.articles_sql()} AS a0)")


DAY = "strftime(publish_date, '%Y-%m-%d')"
OPINION = "coalesce(contains(lower(section), 'opinion'), false)"


# =============================================================================
# Scans, filters, sampling (SRC-1, F-1, F-2, F-3, L-1, L-2)
# =============================================================================

MONTH_FROM, MONTH_TO = "2013-09-01", "2013-10-01"
SCAN_MEDIA = ["1", "2", "6", "7", "1150", "1757", "27502", "314"]


@query("story_scan", f"""
SELECT media_id, stories_id, {DAY} AS publish_day, url FROM {D.stories_sql()} AS s
WHERE publish_date >= TIMESTAMP '{MONTH_FROM}' AND publish_date < TIMESTAMP '{MONTH_TO}'
  AND media_id IN ({', '.join(D.q(m) for m in SCAN_MEDIA)})""")
def story_scan(spark, sf):
    st = S.story_scan(D.stories(spark, sf), MONTH_FROM, MONTH_TO, SCAN_MEDIA)
    return st.select("media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"), "url")


@query("media_set_semi", f"""
SELECT media_id, stories_id FROM {D.stories_sql()} AS s
WHERE media_id IN (SELECT media_id FROM {D.media_set_sql()} AS ms WHERE media_sets_id = 1)""")
def media_set_semi(spark, sf):
    return S.in_media_set(D.stories(spark, sf), D.media_set(spark), 1).select("media_id", "stories_id")


@query("random_sample", f"""
SELECT stories_id, media_id, url FROM {D.stories_sql()} AS s
ORDER BY (stories_id * {S.MIX_MULT} + 1) % {S.MIX_MOD}, stories_id LIMIT 50""")
def random_sample(spark, sf):
    return S.sample_stories(D.stories(spark, sf), 50).select("stories_id", "media_id", "url")


@query("story_page", f"""
SELECT stories_id, media_id FROM {D.stories_sql()} AS s ORDER BY stories_id LIMIT 50 OFFSET 100""")
def story_page(spark, sf):
    return S.page(D.stories(spark, sf), 100, 50).select("stories_id", "media_id")


@query("large_sample", f"""
SELECT stories_id, media_id FROM (SELECT *, row_number() OVER (ORDER BY (stories_id * {S.MIX_MULT} + 1) % {S.MIX_MOD}, stories_id) AS k,
       count(*) OVER () AS n FROM {D.stories_sql()} AS s) AS t WHERE k <= n // 3""")
def large_sample(spark, sf):
    """A third of all stories by the histogram cut, at any size (a small sample is a top-k)."""
    st = D.stories(spark, sf)
    return S.sample_below_cut(st, st.count() // 3).select("stories_id", "media_id")


@query("deep_story_page", f"""
SELECT stories_id, media_id FROM (SELECT *, row_number() OVER (ORDER BY stories_id) AS k, count(*) OVER () AS n
       FROM {D.stories_sql()} AS s) AS t WHERE k > n // 2 AND k <= n // 2 + 500""")
def deep_story_page(spark, sf):
    """500 stories from the middle of the list, by prefix sums of id ranges."""
    st = D.stories(spark, sf)
    return S.deep_page(st, st.count() // 2, 500).select("stories_id", "media_id")


@query("closed_month_scan", f"""
SELECT media_id, stories_id, {DAY} AS publish_day FROM {D.stories_sql()} AS s
WHERE publish_date >= TIMESTAMP '{MONTH_FROM}' AND publish_date <= TIMESTAMP '{MONTH_TO}'""")
def closed_month_scan(spark, sf):
    """SRC-1 in its sentence form (three sentences a story, the first is the story) over a range closed at both ends."""
    from quillstat.sources import readers
    sentences = D.stories(spark, sf).withColumn("sentence_number", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    st = S.story_scan(readers.stories_from_sentences(sentences), MONTH_FROM, MONTH_TO, closed=True)
    return st.select("media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"))


# =============================================================================
# Extraction (X-1 … X-10, J-1, J-7, P-2, L-3)
# =============================================================================

@query("section_from_url", f"""
SELECT s.stories_id, m.outlet, {Q.section_from_url('m.outlet', 's.url')} AS section_url
FROM {D.stories_sql()} AS s LEFT JOIN {D.media_sql()} AS m ON s.media_id = m.media_id""")
def section_from_url(spark, sf):
    st = X.with_outlet(D.stories(spark, sf))
    return st.select("stories_id", "outlet", X.section_from_url("outlet", "url").alias("section_url"))


@query("byline_extract", f"""
SELECT stories_id, media_id, byline, byline_rule, status FROM {Q.articles_sql()} AS a""")
def byline_extract(spark, sf):
    a = X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf))
    return a.select("stories_id", "media_id", "byline", "byline_rule", "status")


@query("section_from_tag", f"""
SELECT stories_id, outlet, section FROM {Q.articles_sql()} AS a""")
def section_from_tag(spark, sf):
    a = X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf))
    return a.select("stories_id", "outlet", "section")


@query("is_opinion", f"""
SELECT stories_id, section, is_opinion,
       CASE WHEN is_opinion IS NULL THEN NULL ELSE false END AS is_opinion_compat
FROM {Q.articles_sql()} AS a""")
def is_opinion(spark, sf):
    a = X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf))
    return a.select("stories_id", "section", "is_opinion",
                    F.when(F.col("status") == "ok", X.is_opinion("outlet", "section", compat=True))
                    .alias("is_opinion_compat"))


@query("extract_metadata", f"""
SELECT media_id, stories_id, {DAY} AS publish_day, url, media_name, byline, female, male, unknown,
       section, is_opinion, status, error
FROM {q_articles()} AS a""")
def extract_metadata(spark, sf):
    a = articles(spark, sf)
    return a.select("media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"),
                    "url", "media_name", "byline", "female", "male", "unknown", "section", "is_opinion",
                    "status", "error")


def _q_labels() -> list[tuple[str, str]]:
    """Opinion labels of a user: those shipped, and one for an outlet that has none."""
    return [*R.OPINION_LABELS, ("dailybeast", "Sports"), ("salon", "arts")]


@query("user_opinion_labels", f"""
SELECT stories_id, section, {Q.is_opinion('outlet', 'section', _q_labels())} AS is_opinion FROM {Q.articles_sql()} AS a WHERE status = 'ok'
UNION ALL SELECT stories_id, section, NULL AS is_opinion FROM {Q.articles_sql()} AS b WHERE status <> 'ok'""")
def user_opinion_labels(spark, sf):
    """X-5 with the user's own labels, also for outlets that have none shipped."""
    labels = spark.createDataFrame(_q_labels(), "outlet string, label string")
    return X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf), labels=labels).select("stories_id", "section", "is_opinion")


KNOWN_MEDIA = [m for m in R.MEDIA if m[0] not in ("1707", "27502")]


@query("unmatched_media", f"""
SELECT media_id, count(*) AS n_stories FROM {D.stories_sql()} AS s
WHERE media_id NOT IN ({', '.join(D.q(m[0]) for m in KNOWN_MEDIA)}) GROUP BY media_id""")
def unmatched_media(spark, sf):
    """J-2: stories of outlets that the report has to know but does not (a media table without two outlets)."""
    media = spark.createDataFrame(KNOWN_MEDIA, "media_id string, media_name string, outlet string")
    return RP.unmatched_report(D.stories(spark, sf), media)


@query("matched_articles", f"""
SELECT a.stories_id, m.media_name, a.section FROM {Q.articles_sql()} AS a JOIN {D.media_sql()} AS m ON a.media_id = m.media_id
WHERE a.media_id IN ({', '.join(D.q(m[0]) for m in KNOWN_MEDIA)})""")
def matched_articles(spark, sf):
    """J-2: the articles of known outlets, with their name (inner join)."""
    media = spark.createDataFrame(KNOWN_MEDIA, "media_id string, media_name string, outlet string")
    return RP.matched_articles(article_table(spark, sf), media).select("stories_id", "media_name", "section")


@query("page_gate", f"""
SELECT count(*) AS n_pages,
       count(*) FILTER (WHERE {Q.any_needle('p.html')}) AS n_parsed FROM {D.pages_sql()} AS p""")
def page_gate(spark, sf):
    """Pages, and those on which any outlet's rule can find something (only these are parsed)."""
    return X.gate_report(D.pages(spark, sf)).select("n_pages", "n_parsed")


@query("bucketed_articles", f"""
SELECT stories_id, media_id, byline, section, status, is_opinion FROM {Q.articles_sql()} AS a""")
def bucketed_articles(spark, sf):
    """J-7: stories and page hits stored as bucketed tables and joined without an exchange."""
    import uuid
    from quillstat.sources import bucketed
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = bucketed.bucketed_articles(D.stories(spark, sf), D.pages(spark, sf), f"q{uuid.uuid4().hex}", _scratch(spark, "bucketed"), n)
    return a.select("stories_id", "media_id", "byline", "section", "status", "is_opinion")


_STRIP_TAGS_DUCK = (r"<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>"
                    r"|<!--.*?-->|<[!?/a-z][^>]*>|&#?[a-z0-9]+;?")


def q_strip_tags(x: str) -> str:
    return f"regexp_replace({x}, {D.q(_STRIP_TAGS_DUCK)}, '\\1\\2', 'gis')"


def q_token_string(x: str) -> str:
    t = Q.tokens(x)
    return (f"array_to_string(list_filter({t}, lambda w: NOT (length(w) = 1 AND "
            f"regexp_matches(w, '[!-/:-@\\[-`{{-~]'))), ' ')")


@query("strip_tags", f"""
SELECT stories_id, {q_strip_tags('html')} AS text FROM {D.pages_sql()} AS p""")
def strip_tags(spark, sf):
    return D.pages(spark, sf).select("stories_id", TX.strip_tags("html").alias("text"))


@query("token_string", f"""
SELECT stories_id, {q_token_string(q_strip_tags('html'))} AS full_text FROM {D.pages_sql()} AS p""")
def token_string(spark, sf):
    return D.pages(spark, sf).select("stories_id", X.full_text_col(F.lit(None).cast("string"), F.col("html"))
                                     .alias("full_text"))


@query("document_tokens", f"""
SELECT doc_id, {q_token_string('text')} AS tokens FROM documents""")
def document_tokens(spark, sf):
    docs = read_table(spark, f"{sf}/documents.parquet")
    return docs.select("doc_id", TX.token_string("text").alias("tokens"))


# =============================================================================
# Names and gender (N-1 … N-13, J-4, J-6, L-4, A-7, U-2)
# =============================================================================

@query("first_names", f"""
SELECT id, {Q.join_names(Q.first_names('byline'))} AS first_names, CAST(len({Q.first_names('byline')}) AS INTEGER) AS n_first
FROM {D.order_bylines_sql()} AS o""")
def first_names(spark, sf):
    o = D.order_bylines(spark, sf).withColumn("_fn", N.first_names("byline"))
    return o.select("id", N.join_names(F.col("_fn")).alias("first_names"), F.size("_fn").alias("n_first"))


@query("full_names", f"""
SELECT id, {Q.join_names(Q.full_names('byline'))} AS people, CAST(len({Q.full_names('byline')}) AS INTEGER) AS n_people
FROM {D.order_bylines_sql()} AS o""")
def full_names(spark, sf):
    o = D.order_bylines(spark, sf).withColumn("_fp", N.full_names("byline"))
    return o.select("id", N.join_names(F.col("_fp")).alias("people"), F.size("_fp").alias("n_people"))


def _q_order_gender() -> str:
    f, m, u = q_gender_counts(Q.first_names("byline"))
    return f"SELECT id, {f} AS female, {m} AS male, {u} AS unknown FROM {D.order_bylines_sql()} AS o"


@query("byline_gender", _q_order_gender())
def byline_gender(spark, sf):
    o = G.byline_gender(D.order_bylines(spark, sf), D.name_gender(spark), sets=_sets(spark))
    return o.select("id", "female", "male", "unknown")


@query("byline_gender_join", _q_order_gender())
def byline_gender_join(spark, sf):
    """Same result through the large-name-table path (explode → join → group)."""
    o = G.byline_gender(D.order_bylines(spark, sf), D.name_gender(spark), key_cols=["id"], max_inline=0)
    return o.select("id", "female", "male", "unknown")


@query("single_name_gender", f"""
SELECT id, person, {q_single_gender('person')} AS gender,
       {q_single_gender("regexp_replace(strip_accents(person), '[^\\x00-\\x7F]', '', 'g')")} AS gender_ascii
FROM (SELECT id, unnest({Q.full_names('byline')}) AS person FROM {D.order_bylines_sql()} AS o) AS t""")
def single_name_gender(spark, sf):
    sets = _sets(spark)
    p = D.order_bylines(spark, sf).select("id", F.explode(N.full_names("byline")).alias("person"))
    both = G.with_gender(G.with_gender(p, F.col("person"), sets), F.col("person"), sets, "gender_ascii", fold=True)
    return both.select("id", "person", "gender", "gender_ascii")


@query("ascii_fold", f"""
SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents""")
def ascii_fold(spark, sf):
    docs = read_table(spark, f"{sf}/documents.parquet")
    return docs.select("doc_id", TX.ascii_fold("text").alias("folded"))


def _q_overrides() -> str:
    labels = ", ".join(D.q(x) for x in R.OVERRIDE_LABELS)
    return (f"(SELECT org, name, arg_max(gender, row_no) AS gender, arg_max(count, row_no) AS count FROM "
            f"(SELECT replace(org, '+', ' ') AS org, replace(name, '+', ' ') AS name, count, gender, row_no "
            f"FROM {D.override_sheet_sql()} AS s0 WHERE gender IN ({labels})) AS s1 GROUP BY org, name)")


def _q_people_counts() -> str:
    return (f"(SELECT media_name AS org, person AS name, count(*) AS n FROM "
            f"(SELECT media_name, unnest({Q.full_names('byline')}) AS person FROM {Q.articles_sql()} AS a "
            f"WHERE {OPINION}) AS t GROUP BY media_name, person)")


def _people_counts(spark, sf):
    return (RP.byline_counts(article_table(spark, sf))
            .select(F.col("media_name").alias("org"), F.col("person").alias("name"), F.col("n_articles").alias("n")))


@query("override_gender", f"""
SELECT p.org, p.name,
       CASE WHEN o1.gender IS NOT NULL THEN o1.gender
            ELSE {q_single_gender("regexp_replace(p.name, '[!-/:-@\\[-`{-~]', '', 'g')")} END AS gender,
       coalesce(o2.gender, '') AS manual_gender
FROM {_q_people_counts()} AS p
LEFT JOIN {_q_overrides()} AS o1
  ON p.org = o1.org AND regexp_replace(p.name, '[!-/:-@\\[-`{{-~]', '', 'g') = o1.name
LEFT JOIN {_q_overrides()} AS o2 ON p.org = o2.org AND p.name = o2.name""")
def override_gender(spark, sf):
    ov = G.prepare_overrides(D.override_sheet(spark, sf))
    p = _people_counts(spark, sf).select("org", "name")
    g = G.org_name_gender(p, ov, _sets(spark))
    return G.online_org_name_gender(g, ov).select("org", "name", "gender", "manual_gender")


@query("override_clean", f"""
SELECT org, name, gender, count FROM {_q_overrides()} AS o""")
def override_clean(spark, sf):
    return G.clean_overrides(D.override_sheet(spark, sf)).select("org", "name", "gender", "count")


@query("org_name_export", f"""
SELECT replace(coalesce(p.org, o.org), ' ', '+') AS org, replace(coalesce(p.name, o.name), ' ', '+') AS name,
       {q_single_gender('coalesce(p.name, o.name)')} AS auto_gender,
       coalesce(p.n, o.count) AS n, coalesce(o.gender, '') AS manual_gender
FROM {_q_people_counts()} AS p FULL OUTER JOIN {_q_overrides()} AS o ON p.org = o.org AND p.name = o.name""")
def org_name_export(spark, sf):
    ov = G.clean_overrides(D.override_sheet(spark, sf))
    return G.org_name_export(_people_counts(spark, sf), ov, _sets(spark))


# =============================================================================
# Reports (A-1 … A-6, A-11, J-2)
# =============================================================================

@query("section_counts", f"""
SELECT media_name, coalesce(section, '') AS section, count(*) AS n_articles
FROM {Q.articles_sql()} AS a GROUP BY media_name, coalesce(section, '')""")
def section_counts(spark, sf):
    return RP.section_counts(article_table(spark, sf))


@query("outlet_totals", f"""
SELECT media_name, count(DISTINCT coalesce(section, '')) AS n_sections, count(*) AS n_articles
FROM {Q.articles_sql()} AS a GROUP BY media_name""")
def outlet_totals(spark, sf):
    return RP.outlet_totals(article_table(spark, sf))


@query("opinion_sections", f"""
SELECT media_name, section, count(*) AS n_articles FROM {Q.articles_sql()} AS a
WHERE {OPINION} GROUP BY media_name, section""")
def opinion_sections(spark, sf):
    return RP.opinion_sections(article_table(spark, sf))


@query("byline_counts", f"""
SELECT org AS media_name, name AS person, n AS n_articles FROM {_q_people_counts()} AS p""")
def byline_counts(spark, sf):
    return RP.byline_counts(article_table(spark, sf))


@query("outlet_people", f"""
SELECT org AS media_name, count(DISTINCT name) AS n_people FROM {_q_people_counts()} AS p GROUP BY org""")
def outlet_people(spark, sf):
    return RP.outlet_people(article_table(spark, sf))


@query("gender_rollup", f"""
SELECT media_name, strftime(publish_date, '%Y-%m') AS publish_month, CAST(sum(female) AS BIGINT) AS female,
       CAST(sum(male) AS BIGINT) AS male, CAST(sum(unknown) AS BIGINT) AS unknown, count(*) AS n_articles
FROM {q_articles()} AS a GROUP BY media_name, strftime(publish_date, '%Y-%m')""")
def gender_rollup(spark, sf):
    a = article_table(spark, sf).withColumn("publish_month", F.date_format("publish_date", "yyyy-MM"))
    return RP.gender_rollup(a, ["media_name", "publish_month"])


# =============================================================================
# Mentions (M-1, M-2, J-9, A-6)
# =============================================================================

def _q_mentions() -> str:
    text = q_token_string(q_strip_tags("html"))
    bigrams = "list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])"
    return (f"(SELECT stories_id, gram AS name, count(*) AS count FROM "
            f"(SELECT stories_id, unnest({bigrams}) AS gram FROM "
            f"(SELECT stories_id, {Q.tokens('full_text')} AS tk FROM "
            f"(SELECT stories_id, {text} AS full_text FROM {D.pages_sql()} AS p) AS t0) AS t) AS g "
            f"WHERE gram IN (SELECT name FROM {D.gazetteer_sql()} AS z) GROUP BY stories_id, gram)")


def _rollups(spark, sf) -> str:
    """Folder of the stored month roll-ups of the article table."""
    def write():
        path = _scratch(spark, "rollups")
        RU.write_rollups(article_table(spark, sf), path)
        return path
    return _memo(spark, f"rollups {sf.rstrip('/')}", write)


@query("rollup_section_counts", f"""
SELECT media_name, coalesce(section, '') AS section, count(*) AS n_articles
FROM {Q.articles_sql()} AS a GROUP BY media_name, coalesce(section, '')""")
def rollup_section_counts(spark, sf):
    """A-1 for all months from the stored month roll-ups."""
    return RU.section_counts(RU.read_rollup(spark, _rollups(spark, sf), RU.SECTIONS))


@query("rollup_half_year", f"""
SELECT t.media_name, t.n_sections, t.n_articles, coalesce(p.n_people, 0) AS n_people
FROM (SELECT media_name, count(DISTINCT coalesce(section, '')) AS n_sections, count(*) AS n_articles FROM {Q.articles_sql()} AS a
      WHERE strftime(publish_date, '%Y-%m') BETWEEN '2013-09' AND '2014-02' GROUP BY media_name) AS t
LEFT JOIN (SELECT media_name, count(DISTINCT person) AS n_people FROM
           (SELECT media_name, unnest({Q.full_names('byline')}) AS person FROM {Q.articles_sql()} AS a2
            WHERE {OPINION} AND strftime(publish_date, '%Y-%m') BETWEEN '2013-09' AND '2014-02') AS x GROUP BY media_name) AS p
  ON t.media_name = p.media_name""")
def rollup_half_year(spark, sf):
    """A-2 and A-5 of six months: distinct sections and people merged exactly from the months' roll-ups."""
    months, path = X.months_between("2013-09-01", "2014-03-01"), _rollups(spark, sf)
    people = RU.outlet_people(RU.read_rollup(spark, path, RU.PEOPLE, months))
    totals = RU.outlet_totals(RU.read_rollup(spark, path, RU.SECTIONS, months))
    return totals.join(people, "media_name", "left").withColumn("n_people", F.coalesce("n_people", F.lit(0)))


@query("rollup_byline_counts", f"""
SELECT org AS media_name, name AS person, n AS n_articles FROM {_q_people_counts()} AS p""")
def rollup_byline_counts(spark, sf):
    """A-4 for all months from the stored month roll-ups."""
    return RU.byline_counts(RU.read_rollup(spark, _rollups(spark, sf), RU.PEOPLE))


def _mentions(spark, sf):
    txt = D.pages(spark, sf).select("stories_id", X.full_text_col(F.lit(None).cast("string"), F.col("html"))
                                    .alias("full_text"))
    return M.gazetteer_mentions(txt, D.gazetteer(spark))


@query("gazetteer_mentions", f"SELECT stories_id, name, count FROM {_q_mentions()} AS m")
def gazetteer_mentions(spark, sf):
    return _mentions(spark, sf)


@query("mentioned_people", f"""
SELECT a.media_name, m.name, CAST(sum(m.count) AS BIGINT) AS n_mentions,
       {q_single_gender("regexp_replace(strip_accents(m.name), '[^\\x00-\\x7F]', '', 'g')")} AS gender
FROM {_q_mentions()} AS m JOIN {Q.articles_sql()} AS a ON m.stories_id = a.stories_id
WHERE {OPINION} GROUP BY a.media_name, m.name""")
def mentioned_people(spark, sf):
    return M.mentioned_people(article_table(spark, sf), mention_table(spark, sf), _sets(spark)) \
        .select("media_name", "name", "n_mentions", "gender")


@query("mention_bylines", f"""
SELECT a.media_name, m.name, a.mentioner, CAST(sum(m.count) AS BIGINT) AS n
FROM {_q_mentions()} AS m
JOIN (SELECT stories_id, media_name, unnest({Q.full_names('byline')}) AS mentioner FROM {Q.articles_sql()} AS a0
      WHERE {OPINION}) AS a ON m.stories_id = a.stories_id
GROUP BY a.media_name, m.name, a.mentioner""")
def mention_bylines(spark, sf):
    return M.mention_bylines(article_table(spark, sf), mention_table(spark, sf))


# =============================================================================
# Evaluation (E-1 … E-6, J-8, A-8, F-5)
# =============================================================================

def _q_eval() -> str:
    x = "lower(" + Q.strip_ws("extracted") + ")"
    a = "lower(" + Q.strip_ws("actual") + ")"
    pos = f"(length({x}) - strpos(reverse({x}), reverse({a})) - length({a}) + 2)"
    extra = (f"CASE WHEN strpos(reverse({x}), reverse({a})) > 0 THEN "
             f"substr({x}, 1, {pos} - 1) || ';' || substr({x}, {pos} + length({a})) END")
    missing = (f"array_to_string(list_transform(list_filter(string_split(actual, ';;'), lambda s: NOT "
               f"list_bool_or(list_transform(string_split(extracted, ';;'), lambda r: "
               f"strpos(lower({Q.strip_ws('r')}), lower({Q.strip_ws('s')})) > 0))), lambda s2: s2 || ';;;'), '')")
    return (f"(SELECT media_id, stories_id, url, extracted AS extracted_byline, actual AS actual_byline, "
            f"CASE WHEN {x} = {a} THEN 'y' ELSE 'n' END AS correct, "
            f"CASE WHEN {x} = {a} THEN '' ELSE coalesce({extra}, '') END AS extra_text, "
            f"CASE WHEN {x} = {a} OR ({extra}) IS NOT NULL THEN '' ELSE {missing} END AS missing_text, "
            f"CASE WHEN {x} = {a} THEN n_names ELSE CAST(n_found AS VARCHAR) END AS n_extracted, "
            f"n_names AS n_actual FROM "
            f"(SELECT l.*, coalesce(e.byline, '') AS extracted, e.female + e.male + e.unknown AS n_found, "
            f"CASE WHEN lower(l.is_correct) = 'y' THEN l.byline_extracted_label ELSE l.byline_corrected END AS actual "
            f"FROM {D.eval_labels_sql()} AS l JOIN {q_articles()} AS e "
            f"ON l.media_id = e.media_id AND l.stories_id = e.stories_id) AS j)")


def _evaluated(spark, sf):
    return E.evaluate(D.eval_labels(spark, sf), article_table(spark, sf))


@query("eval_rows", f"SELECT * FROM {_q_eval()} AS v")
def eval_rows(spark, sf):
    return _evaluated(spark, sf)


@query("eval_accuracy", f"""
SELECT n_correct, n_incorrect,
       round(CASE WHEN n_correct + n_incorrect = 0 THEN NULL
             ELSE n_correct::DOUBLE / (n_correct + n_incorrect) END, 6) AS accuracy
FROM (SELECT count(*) FILTER (WHERE correct = 'y')
             + count(*) FILTER (WHERE correct = 'n' AND lower({Q.strip_ws('extracted_byline')}) =
                                                         lower({Q.strip_ws('actual_byline')})) AS n_correct,
             count(*) FILTER (WHERE correct = 'n' AND lower({Q.strip_ws('extracted_byline')}) <>
                                    lower({Q.strip_ws('actual_byline')}) AND length(actual_byline) > 0) AS n_incorrect
      FROM {_q_eval()} AS v) AS t""")
def eval_accuracy(spark, sf):
    return E.accuracy(_evaluated(spark, sf))


# =============================================================================
# Legacy rule table: extraction, two-way routing, summary (X-8, J-3, SNK-2, A-10)
# =============================================================================

def _q_legacy() -> str:
    per: dict[str, list[tuple]] = {}
    for mid, tag, attr, value, prio in R.legacy_rule_rows():
        per.setdefault(mid, []).append((tag, attr, value))
    st_w, fw_w, by_w = [], [], []
    for mid, lst in per.items():
        s_i, f_i, b_i = [], [], []
        for tag, attr, value in lst:
            v = Q._re_escape(value)
            if attr == "class":
                open_rx = f'<{tag} {attr}="([^"]* )?{v}( [^"]*)?"'
            else:
                open_rx = f'<{tag} {attr}="{v}"'
            det = f"regexp_matches(p.html, {D.q(open_rx + '[ >/]')})"
            label = D.q(f"{tag}[{attr}={value}]")
            if tag == "meta":
                content_rx = D.q(open_rx + ' content="([^"]*)"')
                has = f"regexp_matches(p.html, {content_rx})"
                s_i.append(f"WHEN {det} THEN CASE WHEN {has} THEN 'found' ELSE 'KeyError' END")
                f_i.append(f"WHEN {det} THEN CASE WHEN {has} THEN {label} END")
                grp = 3 if attr == "class" else 1
                b_i.append(f"WHEN {det} THEN CASE WHEN {has} THEN regexp_extract(p.html, {content_rx}, {grp}) END")
            else:
                text_rx = D.q(open_rx + "[^>]*>([^<]*)<")
                grp = 3 if attr == "class" else 1
                s_i.append(f"WHEN {det} THEN 'found'")
                f_i.append(f"WHEN {det} THEN {label}")
                b_i.append(f"WHEN {det} THEN regexp_extract(p.html, {text_rx}, {grp})")
        st_w.append(f"WHEN {D.q(mid)} THEN (CASE {' '.join(s_i)} ELSE 'Included not found' END)")
        fw_w.append(f"WHEN {D.q(mid)} THEN (CASE {' '.join(f_i)} END)")
        by_w.append(f"WHEN {D.q(mid)} THEN (CASE {' '.join(b_i)} END)")
    return (f"(SELECT s.media_id, s.url, s.stories_id, "
            f"CASE s.media_id {' '.join(fw_w)} END AS foundwith, "
            f"CASE s.media_id {' '.join(by_w)} END AS byline, "
            f"CASE s.media_id {' '.join(st_w)} ELSE 'Not included' END AS status "
            f"FROM {D.stories_sql()} AS s LEFT JOIN {D.pages_sql()} AS p ON s.stories_id = p.stories_id)")


def _legacy(spark, sf):
    """The stored legacy result: pages are parsed once, the legacy queries read this."""
    return _stored(spark, sf, "legacy", lambda: X.legacy_extract(D.stories(spark, sf), D.pages(spark, sf)))


@query("legacy_found", f"""
SELECT media_id, url, stories_id, foundwith, byline FROM {_q_legacy()} AS l WHERE status = 'found'""")
def legacy_found(spark, sf):
    return X.route(_legacy(spark, sf))[0]


@query("legacy_failed", f"""
SELECT media_id, url, stories_id, status AS reason FROM {_q_legacy()} AS l WHERE status <> 'found'""")
def legacy_failed(spark, sf):
    return X.route(_legacy(spark, sf))[1]


@query("legacy_found_rate", f"""
SELECT count(*) FILTER (WHERE status = 'found') AS n_found, count(*) AS n_stories,
       round(count(*) FILTER (WHERE status = 'found')::DOUBLE / count(*), 6) AS rate
FROM {_q_legacy()} AS l""")
def legacy_found_rate(spark, sf):
    from quillstat.sources.readers import found_rate
    return found_rate(_legacy(spark, sf))


@query("extraction_summary", f"""
SELECT media_id, status, foundwith, count(*) AS n_stories FROM {_q_legacy()} AS l
GROUP BY media_id, status, foundwith""")
def extraction_summary(spark, sf):
    return X.extraction_summary(_legacy(spark, sf))


# =============================================================================
# Sinks and sources round trip, stream ingest (SNK-1, SRC-9, U-1, SRC-2)
# =============================================================================

def _scratch(spark, name: str) -> str:
    import uuid
    from quillstat.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("month_union", f"""
SELECT media_id, stories_id, {DAY} AS publish_day, byline, female, male, unknown, section, is_opinion
FROM {q_articles()} AS a""")
def month_union(spark, sf):
    """Articles written as month CSV files (text form, 'None' for null) and read back
    from the list of month folders as one table."""
    from quillstat.sources import readers, sinks
    out = _scratch(spark, "months")
    sinks.write_articles(article_table(spark, sf), out, fmt="csv", by_size=True)
    months = [r.m for r in spark.read.option("header", True).csv(out).select(
        F.col("publish_month").cast("string").alias("m")).distinct().collect()]
    back = readers.read_month_files(spark, [f"{out}/publish_month={m}" for m in sorted(months)])
    return back.select("media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"),
                       "byline", "female", "male", "unknown", "section", "is_opinion")


@query("stream_ingest", f"""
SELECT media_id, stories_id, {DAY} AS publish_day, url FROM {D.stories_sql()} AS s""")
def stream_ingest(spark, sf):
    """Story drops by closed month ranges (neighbouring drops share their edge day) are
    ingested as a stream; each story comes out once."""
    from quillstat.streaming import ingest
    st = D.stories(spark, sf)
    src, sink, ck = _scratch(spark, "drops"), _scratch(spark, "ingested"), _scratch(spark, "ingest-ckpt")
    month = F.date_trunc("month", F.col("publish_date"))
    first_next = F.add_months(month, 1).cast("timestamp")
    # every story goes to its month's drop; a story on the 1st also goes to the previous drop
    edge = st.where(F.col("publish_date") == month).withColumn("drop", F.date_format(F.add_months(month, -1), "yyyy-MM"))
    main = st.withColumn("drop", F.date_format(month, "yyyy-MM"))
    drops = main.unionByName(edge).where(F.col("publish_date") <= first_next)
    drops.hint("rebalance", F.col("drop")).write.partitionBy("drop").parquet(src)
    try:
        parts = spark.sparkContext.defaultParallelism
    except Exception:
        parts = None
    # several micro-batches (state carried across them); state partitions ~ cores and the
    # default (in-memory, checkpointed) state store for a state of a few thousand ids
    q = ingest.ingest(spark, f"{src}/*", sink, ck, max_files_per_trigger=8, state_partitions=parts,
                      state_store=None)
    q.awaitTermination()
    return spark.read.schema(st.schema).parquet(sink).select(
        "media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"), "url")


# =============================================================================
# Two-tier extraction, story total, full-text table (P-3, A-9, SNK-4 / X-10)
# =============================================================================

@query("fallback_extract", f"""
SELECT media_id, stories_id, byline, section, byline_rule, status, is_opinion
FROM {Q.articles_sql(fallback_pages="(SELECT page_id AS stories_id, html FROM pages)")} AS a""")
def fallback_extract(spark, sf):
    """Stored files = the derived pages (some fail); second tier = the raw archived pages."""
    archive = read_table(spark, f"{sf}/pages.parquet").select(F.col("page_id").alias("stories_id"), "html")
    a = X.extract_with_fallback(D.stories(spark, sf), D.pages(spark, sf), archive)
    return a.select("media_id", "stories_id", "byline", "section", "byline_rule", "status", "is_opinion")


@query("story_total", f"""
SELECT count(*) AS n_stories FROM {D.stories_sql()} AS s
WHERE publish_date >= TIMESTAMP '{MONTH_FROM}' AND publish_date < TIMESTAMP '{MONTH_TO}'
  AND media_id IN ({', '.join(D.q(m) for m in SCAN_MEDIA)})""")
def story_total(spark, sf):
    st = S.story_scan(D.stories(spark, sf), MONTH_FROM, MONTH_TO, SCAN_MEDIA)
    return st.agg(F.count(F.lit(1)).alias("n_stories"))


@query("full_text_articles", f"""
SELECT a.stories_id, a.byline, a.section, {q_token_string(q_strip_tags('p.html'))} AS full_text
FROM {Q.articles_sql()} AS a LEFT JOIN {D.pages_sql()} AS p ON a.stories_id = p.stories_id""")
def full_text_articles(spark, sf):
    a = X.extract_metadata(D.stories(spark, sf), D.pages(spark, sf), full_text=True)
    return a.select("stories_id", "byline", "section", "full_text")


STORY_TEXT_SQL = "(CASE WHEN stories_id % 3 = 0 THEN 'Text of story ' || CAST(stories_id AS STRING) || ', as known (' || CAST(stories_id % 7 AS STRING) || ').' END)"


@query("known_story_text", f"""
SELECT a.stories_id, a.byline, {q_token_string(f"coalesce({STORY_TEXT_SQL.replace('stories_id', 'a.stories_id')}, {q_strip_tags('p.html')})")} AS full_text
FROM {Q.articles_sql()} AS a LEFT JOIN {D.pages_sql()} AS p ON a.stories_id = p.stories_id""")
def known_story_text(spark, sf):
    """X-10: every third page comes with its story text, which goes before the page's own text."""
    pages = D.pages(spark, sf).withColumn("story_text", F.expr(STORY_TEXT_SQL))
    return X.extract_metadata(D.stories(spark, sf), pages, full_text=True).select("stories_id", "byline", "full_text")


BROKEN_TAG = '<head><meta name="CG">'


@query("section_tag_errors", f"""
SELECT a.stories_id,
       CASE WHEN b.status <> 'ok' OR (a.outlet = 'nyt' AND a.stories_id % 3 = 0 AND (a.stories_id // 10) % 2 = 0) THEN 'failed' ELSE 'ok' END AS status
FROM {Q.articles_sql()} AS a JOIN {Q.articles_sql()} AS b ON a.stories_id = b.stories_id""")
def section_tag_errors(spark, sf):
    """P-2: pages whose first section tag lacks its attribute fail where the URL tells no section, and only there."""
    tens, third = F.floor(F.col("stories_id") / 10) % 2, F.col("stories_id") % 3
    st = D.stories(spark, sf).withColumn("url", F.when((F.col("media_id") == "1") & (tens == 0), F.lit("http://example.invalid/x")).otherwise(F.col("url")))
    pages = D.pages(spark, sf).withColumn("html", F.when(third == 0, F.replace("html", F.lit("<head>"), F.lit(BROKEN_TAG))).otherwise(F.col("html")))
    return X.extract_metadata(st, pages).select("stories_id", "status")


@query("ingest_batches", f"""
SELECT media_id, stories_id, {DAY} AS publish_day, strftime(publish_date, '%Y-%m') AS publish_month FROM {D.stories_sql()} AS s""")
def ingest_batches(spark, sf):
    """SRC-2 without state: overlapping drops, one batch a drop, against the stored month table."""
    from quillstat.streaming import ingest
    st = D.stories(spark, sf).drop("publish_month")
    src, sink, ck = (_scratch(spark, n) for n in ("drops", "month-table", "batches-ckpt"))
    drops = F.array(F.pmod(F.col("stories_id"), F.lit(3)), F.pmod(F.col("stories_id") + 1, F.lit(3)))  # every story in two drops
    st.withColumn("drop", F.explode(drops)).hint("rebalance", F.col("drop")).write.partitionBy("drop").parquet(src)
    ingest.ingest_batches(spark, f"{src}/*", sink, ck, max_files_per_trigger=1).awaitTermination()
    return ingest.stored_stories(spark, sink).select("media_id", "stories_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_day"),
                                                     "publish_month")


# =============================================================================
# Files written and read back (SRC-4 … SRC-8, SNK-2, SNK-5)
# =============================================================================

@query("story_list_file", f"""
SELECT media_id, {DAY} AS publish_day, stories_id, url, CAST(stories_id AS VARCHAR) || '.html' AS file_name
FROM {D.stories_sql()} AS s""")
def story_list_file(spark, sf):
    from quillstat.sources import readers
    out = _scratch(spark, "story-list")
    st = D.stories(spark, sf).select("media_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"), "stories_id",
                                     "url", F.concat(F.col("stories_id").cast("string"), F.lit(".html")).alias("file_name"))
    st.write.option("header", True).csv(out)
    return readers.read_story_list(spark, out).withColumnRenamed("publish_date", "publish_day")


@query("stored_pages", f"""
SELECT stories_id, media_id, byline, section, status FROM {Q.articles_sql()} AS a""")
def stored_pages(spark, sf):
    """Every page stored in container files, read back by split and extracted."""
    from quillstat.sources import containers
    out = _scratch(spark, "stored-pages")
    containers.write_page_container(D.pages(spark, sf), out)
    a = X.extract_metadata(D.stories(spark, sf), containers.read_page_container(spark, out))
    return a.select("stories_id", "media_id", "byline", "section", "status")


@query("label_sheet_file", f"SELECT * FROM {_q_eval()} AS v")
def label_sheet_file(spark, sf):
    """The hand-label sheet as files with two header rows each, read back and evaluated."""
    from quillstat.sources import readers
    out = _scratch(spark, "label-sheet")
    cols = ["media_id", "stories_id", "url", "note", "byline_extracted_label", "is_correct", "byline_corrected", "checked", "n_names"]
    labels = D.eval_labels(spark, sf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = labels.withColumns({"note": F.lit("a note,\nof two lines"), "checked": F.lit(None).cast("string"), "line": F.lit(1),
                               "sheet": F.pmod(F.xxhash64("stories_id"), F.lit(n))})
    second = spark.range(n).select(*[F.lit(f"{c} (2)").alias(c) for c in cols], F.lit(0).alias("line"), F.col("id").alias("sheet"))
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in cols], "line", "sheet").unionByName(second)
    # a sheet's rows meet in one task, its second header first; the writer puts the first header before them
    texts.repartition(n, "sheet").sortWithinPartitions("sheet", "line").select(*cols, "sheet").write.partitionBy("sheet") \
        .option("header", True).option("escape", '"').csv(out)
    return E.evaluate(readers.read_eval_labels(spark, out), article_table(spark, sf))


@query("legacy_rule_file", f"""
SELECT media_id, stories_id, foundwith, byline, status FROM {_q_legacy()} AS l""")
def legacy_rule_file(spark, sf):
    """The legacy rules as a file with its repeated column name, read and applied to all stories."""
    from quillstat.sources import readers
    out = _scratch(spark, "legacy-rules")
    lines = ["media_id,tag,attr,attr"] + [",".join(f'"{x}"' for x in r[:4]) for r in R.legacy_rule_rows()]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(out)
    legacy = X.legacy_extract(D.stories(spark, sf), D.pages(spark, sf), legacy_rules=readers.read_legacy_rules(spark, out))
    return legacy.select("media_id", "stories_id", "foundwith", "byline", "status")


@query("override_sheet_file", f"""
SELECT org, name, gender, count FROM {_q_overrides()} AS o""")
def override_sheet_file(spark, sf):
    """The override sheet written in row order, one header in each file, and read back in that order."""
    from quillstat.sources import readers
    out = _scratch(spark, "override-sheet")
    s = D.override_sheet(spark, sf).orderBy("row_no")
    s.select("org", "name", F.lit("x").alias("note"), "count", "gender").write.option("header", True).option("escape", '"').csv(out)
    return G.clean_overrides(readers.read_override_sheet(spark, out)).select("org", "name", "gender", "count")


@query("routed_roundtrip", f"""
SELECT media_id, url, stories_id, foundwith, byline, status FROM {_q_legacy()} AS l""")
def routed_roundtrip(spark, sf):
    from quillstat.sources import readers, sinks
    out = _scratch(spark, "routed")
    sinks.write_routed(_legacy(spark, sf), f"{out}/found", f"{out}/failed")
    return readers.read_routed_results(spark, f"{out}/found", f"{out}/failed", header=True)


@query("run_log", f"""
SELECT 'run-' || CAST(stories_id % 2 AS VARCHAR) AS run_id, count(*) AS n_rows FROM {_q_eval()} AS v GROUP BY stories_id % 2""")
def run_log(spark, sf):
    """SNK-3: two evaluation runs, each with a line of the run log; the rows of the runs that the log lists."""
    from quillstat.sources import sinks
    out, rows = _scratch(spark, "logged-runs"), _evaluated(spark, sf)
    for i in range(2):
        part = rows.where(F.col("stories_id") % 2 == i)
        sinks.write_run_results(part.select("media_id", "stories_id"), part, out, f"run-{i}")
        sinks.append_run_log(spark, f"{out}/run_log", f"run-{i}")
    logged = spark.read.text(f"{out}/run_log").select(F.regexp_extract("value", r"^\d{4}-\d\d-\d\dT[0-9:.]+: (.*)$", 1).alias("run_id"))
    results = spark.read.parquet(f"{out}/evaluated_results").select(F.col("run_id").cast("string").alias("run_id"))
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(logged), "run_id", "left_semi")


@query("run_results", f"""
SELECT stories_id, extracted_byline, actual_byline, correct, 'run-1' AS run_id FROM {_q_eval()} AS v""")
def run_results(spark, sf):
    from quillstat.sources import sinks
    out = _scratch(spark, "runs")
    sinks.write_run_results(article_table(spark, sf).select("media_id", "stories_id", "byline", "section"), _evaluated(spark, sf), out, "run-1")
    return spark.read.parquet(f"{out}/evaluated_results").select(
        "stories_id", "extracted_byline", "actual_byline", "correct", F.col("run_id").cast("string").alias("run_id"))
