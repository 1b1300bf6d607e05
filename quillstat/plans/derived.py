"""Story inputs derived from the driver tables.

The driver tables hold pages and orders but no bylines. This module projects
them, row by row and deterministically, into the reference's data model:
``stories`` (media_id, stories_id, publish_date, url, byline) and page HTML with
an outlet-specific byline tag (and section tag) injected.

Every derived column is written ONCE as a portable SQL fragment that Spark SQL
and DuckDB evaluate identically; Spark runs it through ``F.expr`` (so Catalyst
sees plain projections and prunes/pushes as usual) and the oracle SQL embeds the
same text. The projection is per row: its cost grows linearly with the tables.

The public functions (``stories``, ``pages``, ...) return the derived tables as
parquet tables written once per session to the shared checkpoint folder (stories and
pages partitioned by ``publish_month``); the ``*_sql`` functions are the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.sources import rules

# ---------------------------------------------------------------------------
# FIXED VALUES (test projection; invented): names, section words, name table.
# ---------------------------------------------------------------------------
FIRST_NAMES = ["Mary", "John", "Linda", "James", "Susan", "Robert", "Karen", "Michael", "Ana", "David"]
SURNAMES = ["Smith", "Lee", "Garcia", "Brown", "Nguyen", "Miller", "Jones", "Davis", "Lopez", "Wilson"]
SECTION_WORDS = ["opinion", "sports", "us/politics", "arts"]
SECTION_TAG_WORDS = ["Opinion", "Sports", "U.S.", "Arts"]
NAME_GENDER = [
    ("mary", "female"), ("john", "male"), ("linda", "female"), ("james", "male"),
    ("susan", "female"), ("robert", "male"), ("karen", "female"), ("michael", "male"),
    ("ana", "female"), ("corwin", "male"), ("odette", "female"), ("jn", "unknown"),
]
MEDIA_IDS = [m[0] for m in rules.MEDIA]


def q(s: str) -> str:
    """SQL string literal (portable: doubled single quotes)."""
    return "'" + s.replace("'", "''") + "'"


def idiv(expr: str, n: int) -> str:
    return f"CAST(FLOOR(({expr}) / {n}) AS BIGINT)"


def pick(expr: str, values: list[str]) -> str:
    """CASE expr % len WHEN i THEN values[i] END."""
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


def name_cols_sql(idc: str) -> dict[str, str]:
    """Layer 0: the names a byline is built from, chosen by id."""
    return {
        "f1": pick(idiv(idc, 3), FIRST_NAMES),
        "f2": pick(f"{idiv(idc, 3)} + 4", FIRST_NAMES),
        "f3": pick(f"{idiv(idc, 3)} + 7", FIRST_NAMES),
        "l1": pick(idiv(idc, 7), SURNAMES),
        "l2": pick(f"{idiv(idc, 7)} + 3", SURNAMES),
        "l3": pick(f"{idiv(idc, 7)} + 5", SURNAMES),
    }


def byline_sql(idc: str) -> str:
    """One of twelve byline shapes by id % 12; references the layer-0 name columns."""
    shapes = [
        "f1 || ' ' || l1",
        "'J. ' || f1 || ' ' || l1",
        "l1 || ', ' || f1",
        "f1 || ' ' || l1 || ' and ' || f2 || ' ' || l2",
        "f1 || ' ' || l1 || '; ' || f2 || ' ' || l2 || ' and ' || f3 || ' ' || l3",
        "f1 || ' ' || l1 || ', ' || f2 || ' ' || l2 || ' and ' || f3 || ' ' || l3",
        "'AP/' || f1 || ' ' || l1 || ' 2013'",
        "''",
        "CAST(NULL AS STRING)",
        "'BY ' || upper(f1) || ' ' || upper(l1)",
        "'Professor ' || f1 || ' ' || l1",
        "f1 || ' ' || l1 || ' for Reuters'",
    ]
    whens = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    return f"(CASE ({idc}) % 12 {whens} END)"


def with_byline(df: DataFrame, idc: str, keep: list[str]) -> DataFrame:
    """Spark: add the byline column to df (two projection layers)."""
    names = [F.expr(v).alias(k) for k, v in name_cols_sql(idc).items()]
    return (df.select(*keep, *names)
            .select(*keep, F.expr(byline_sql(idc)).alias("byline")))


def byline_from_sql(idc: str, cols: str, table: str) -> str:
    """DuckDB: ``SELECT cols, byline FROM table`` with the same two layers."""
    names = ", ".join(f"{v} AS {k}" for k, v in name_cols_sql(idc).items())
    return (f"(SELECT {cols}, {byline_sql(idc)} AS byline FROM "
            f"(SELECT {cols}, {names} FROM {table}) AS l0)")


def media_id_sql(idc: str) -> str:
    return pick(idc, MEDIA_IDS)


def publish_date_sql(idc: str) -> str:
    return f"(DATE '2013-08-01' + CAST(({idc}) % 365 AS INT))"


def section_word_sql(idc: str) -> str:
    return pick(idiv(idc, 10), SECTION_WORDS)


def url_sql(idc: str) -> str:
    d = publish_date_sql(idc)
    ymd = (f"CAST(year({d}) AS STRING) || '/' || lpad(CAST(month({d}) AS STRING), 2, '0') || '/' || "
           f"lpad(CAST(day({d}) AS STRING), 2, '0')")
    w = section_word_sql(idc)
    sid = f"CAST({idc} AS STRING)"
    alt = f"{idiv(idc, 10)} % 2 = 0"
    by_media = {
        "1": f"'http://www.nytimes.com/' || {ymd} || '/' || {w} || '/story-' || {sid} || '.html'",
        "2": (f"CASE WHEN {alt} THEN 'http://feeds.washingtonpost.com/c/34656/f/636708/s/' || {sid} || "
              f"'/l/0L0Swashingtonpost0N0C' || replace({w}, '/', '0C') || 's0Cstory' || {sid} || '/story01.htm' "
              f"ELSE 'http://www.washingtonpost.com/wp-dyn/content/article/' || {ymd} || '/AR' || {sid} || "
              f"'.html?nav=rss_' || replace({w}, '/', '') END"),
        "6": f"'http://feeds.latimes.com/~r/latimes/news/' || {w} || '/~3/' || {sid} || '/'",
        "7": f"'http://www.nypost.com/p/' || {w} || '/story_' || {sid} || '?CMP=OTC-rss&FEEDNAME='",
        "1150": f"'http://online.wsj.com/article/SB' || {sid} || '.html'",
        "1757": f"'http://www.salon.com/' || {ymd} || '/story_' || {sid} || '/'",
        "1707": f"'http://www.thedailybeast.com/' || {w} || '/' || {ymd} || '/story-' || {sid} || '.html'",
        "1750": f"'http://www.telegraph.co.uk/' || {w} || '/' || {sid} || '/story.html'",
        "314": f"'http://www.huffingtonpost.com/' || {ymd} || '/story_' || {sid} || '.html'",
        "27502": f"'http://www.huffingtonpost.com/' || {ymd} || '/story_' || {sid} || '.html'",
    }
    m = media_id_sql(idc)
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in by_media.items())
    return f"(CASE {m} {whens} END)"


# --- HTML snippets ---------------------------------------------------------

def _open_close(selector: str) -> tuple[str, str, str | None]:
    """HTML that a selector of the rule subset finds: (open tags, close tags, tag of last step)."""
    opens, closes, last = [], [], None
    for step in selector.split(" "):
        if "[" not in step:
            opens.append(f"<{step}>")
            closes.insert(0, f"</{step}>")
            last = step
            continue
        tag, rest = step.split("[", 1)
        attr, val = rest.rstrip("]").split("=", 1)
        val = val.strip('"')
        if attr.endswith("^"):
            attr, val = attr[:-1], val + "x"
        opens.append(f'<{tag} {attr}="{val}">')
        closes.insert(0, f"</{tag}>")
        last = tag
    return "".join(opens), "".join(closes), last


def _rule_value(regex: str | None, by: str) -> str:
    """Text put in the tag so that regex rules see a realistic value."""
    if regex is None:
        return by
    if regex.startswith("^By"):
        return f"'By ' || {by}"
    if "contact the reporter" in regex:
        return f"{by} || ' contact the reporter'"
    return f"'August 1, 2013|By ' || {by}"


def byline_snippets_sql() -> tuple[str, str]:
    """(head snippet, body snippet) carrying the byline for the chosen rule, '' when none.

    References the layer-1 columns media_id, byline, rk (rule key) and brk (broken flag).
    """
    outlet_of = {mid: outlet for mid, _, outlet in rules.MEDIA}
    per_outlet: dict[str, list[tuple]] = {}
    for outlet, sel, attr, rx, grp in rules.BYLINE_RULES:
        per_outlet.setdefault(outlet, []).append((sel, attr, rx))
    head_whens, body_whens = [], []
    for mid, outlet in outlet_of.items():
        lst = per_outlet.get(outlet, [])
        for i, (sel, attr, rx) in enumerate(lst, start=1):
            cond = f"media_id = {q(mid)} AND rk % {len(lst)} + 1 = {i}"
            o, c, _ = _open_close(sel)
            val = _rule_value(rx, "byline")
            if attr:  # meta tag in head; every 50th story loses the attribute (a failed story)
                o2 = o[:-1]
                head_whens.append(
                    f"WHEN {cond} THEN CASE WHEN brk THEN {q(o2 + '>')} "
                    f"ELSE {q(o2 + ' ' + attr + '=' + chr(34))} || {val} || {q(chr(34) + '>')} END")
            else:
                body_whens.append(f"WHEN {cond} THEN {q(o)} || {val} || {q(c)}")
    head = f"(CASE WHEN byline IS NULL THEN '' {' '.join(head_whens)} ELSE '' END)"
    body = f"(CASE WHEN byline IS NULL THEN '' {' '.join(body_whens)} ELSE '' END)"
    return head, body


def section_snippets_sql() -> tuple[str, str]:
    """Section tag for outlets that have tag rules; references media_id, sk, stw."""
    outlet_of = {mid: outlet for mid, _, outlet in rules.MEDIA}
    per_outlet: dict[str, list[tuple]] = {}
    for outlet, sel, attr in rules.SECTION_TAG_RULES:
        per_outlet.setdefault(outlet, []).append((sel, attr))
    head_whens, body_whens = [], []
    for mid, outlet in outlet_of.items():
        lst = per_outlet.get(outlet, [])
        for i, (sel, attr) in enumerate(lst, start=1):
            cond = f"media_id = {q(mid)} AND sk % {len(lst)} + 1 = {i}"
            o, c, _ = _open_close(sel)
            if attr:
                head_whens.append(f"WHEN {cond} THEN {q(o[:-1] + ' ' + attr + '=' + chr(34))} || stw || "
                                  f"{q(chr(34) + '>')}")
            else:
                body_whens.append(f"WHEN {cond} THEN {q(o)} || stw || {q(c)}")
    head = f"(CASE {' '.join(head_whens)} ELSE '' END)"
    body = f"(CASE {' '.join(body_whens)} ELSE '' END)"
    return head, body


def page_layer1_sql(idc: str) -> dict[str, str]:
    """Per-page derived columns used to build the injected HTML."""
    return {
        "media_id": media_id_sql(idc),
        "rk": idiv(idc, 10),
        "sk": idiv(idc, 40),
        "brk": f"(({idc}) % 50 = 49)",
        "stw": pick(idiv(idc, 10), SECTION_TAG_WORDS),
    }


MENTION_SQL = "'<p>' || f2 || ' ' || l3 || ' met ' || f3 || ' ' || l2 || ' and ' || f1 || ' ' || l1 || ' on Monday.</p>'"


def html_sql(html_col: str) -> str:
    bh, bb = byline_snippets_sql()
    sh, sb = section_snippets_sql()
    return (f"replace(replace(replace({html_col}, '</head>', {bh} || {sh} || '</head>'), "
            f"'<body>', '<body>' || {bb} || {sb}), '<article>', '<article>' || mention)")


# --- Spark side ------------------------------------------------------------

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from quillstat.sources.readers import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _build_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story records (media_id, stories_id, publish_date, url), one per driver page."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("stories_id"))
    return p.select(
        F.expr(media_id_sql("stories_id")).alias("media_id"),
        "stories_id",
        F.expr(publish_date_sql("stories_id")).cast("timestamp").alias("publish_date"),
        F.expr(url_sql("stories_id")).alias("url"),
    )


def _build_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page HTML per story with the byline/section tags injected (stories_id, html)."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("stories_id"), "html")
    names = [F.expr(v).alias(k) for k, v in name_cols_sql("stories_id").items()]
    layer1 = [F.expr(v).alias(k) for k, v in page_layer1_sql("stories_id").items()]
    return (p.select("stories_id", "html", *names)
            .select("stories_id", "html", F.expr(byline_sql("stories_id")).alias("byline"),
                    F.expr(MENTION_SQL).alias("mention"), *layer1)
            .select("stories_id", F.expr(html_sql("html")).alias("html")))


def _build_story_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byline each derived page carries (ground truth for evaluation)."""
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("stories_id"))
    return with_byline(p, "stories_id", ["stories_id"])


def _build_order_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume input for the name operators: one byline per order (id, media_id, byline)."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    o = o.select("id", F.expr(media_id_sql("id")).alias("media_id"))
    return with_byline(o, "id", ["id", "media_id"])


def name_gender(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_GENDER, "first_name string, gender string")


# --- DuckDB side (same fragments) -----------------------------------------

def stories_sql() -> str:
    i = "page_id"
    return (f"(SELECT {media_id_sql(i)} AS media_id, page_id AS stories_id, "
            f"CAST({publish_date_sql(i)} AS TIMESTAMP) AS publish_date, {url_sql(i)} AS url "
            f"FROM pages)")


def pages_sql() -> str:
    l1 = ", ".join(f"{v} AS {k}" for k, v in page_layer1_sql("stories_id").items())
    names = ", ".join(f"{v} AS {k}" for k, v in name_cols_sql("stories_id").items())
    l0 = f"(SELECT page_id AS stories_id, html, {names} FROM pages)"
    return (f"(SELECT stories_id, {html_sql('html')} AS html FROM "
            f"(SELECT stories_id, html, {byline_sql('stories_id')} AS byline, {MENTION_SQL} AS mention, {l1} "
            f"FROM {l0} AS l0) AS l1)")


def story_bylines_sql() -> str:
    return byline_from_sql("stories_id", "stories_id", "(SELECT page_id AS stories_id FROM pages)")


def order_bylines_sql() -> str:
    return byline_from_sql("id", "id, media_id",
                           f"(SELECT o_orderkey AS id, {media_id_sql('o_orderkey')} AS media_id FROM orders)")


def name_gender_sql() -> str:
    vals = ", ".join(f"({q(a)}, {q(b)})" for a, b in NAME_GENDER)
    return f"(SELECT * FROM (VALUES {vals}) AS t(first_name, gender))"


def media_sql() -> str:
    vals = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in rules.MEDIA)
    return f"(SELECT * FROM (VALUES {vals}) AS t(media_id, media_name, outlet))"


# --- further derived inputs: media set, override sheet, label sheet, gazetteer ----

# FIXED VALUES (test projection; invented): members of media set 1.
MEDIA_SET_1 = ["1", "2", "6", "7", "1150", "314", "27502"]
OVERRIDE_GENDERS = ["male", "female", "unknown", "ignore", "Female"]


def media_set(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, m) for m in MEDIA_SET_1], "media_sets_id int, media_id string")


def media_set_sql() -> str:
    vals = ", ".join(f"(1, {q(m)})" for m in MEDIA_SET_1)
    return f"(SELECT * FROM (VALUES {vals}) AS t(media_sets_id, media_id))"


def _override_cols(idc: str) -> dict[str, str]:
    return {
        "org": f"replace({pick(idc, [m[1] for m in rules.MEDIA])}, ' ', '+')",
        "name": "lower(f1) || '+' || lower(l1)",
        "count": "CAST(c_nationkey AS BIGINT)",
        "gender": pick(idiv(idc, 11), OVERRIDE_GENDERS),
        "row_no": f"CAST({idc} AS BIGINT)",
    }


def _build_override_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual override sheet rows (org, name, count, gender, row_no), one per customer."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = [F.expr(v).alias(k) for k, v in name_cols_sql("c_custkey").items()]
    return (c.select("c_custkey", "c_nationkey", *names)
            .select(*[F.expr(v).alias(k) for k, v in _override_cols("c_custkey").items()]))


def override_sheet_sql() -> str:
    names = ", ".join(f"{v} AS {k}" for k, v in name_cols_sql("c_custkey").items())
    cols = ", ".join(f"{v} AS {k}" for k, v in _override_cols("c_custkey").items())
    return f"(SELECT {cols} FROM (SELECT c_custkey, c_nationkey, {names} FROM customer) AS l0)"


def _label_cols(idc: str) -> dict[str, str]:
    return {
        "media_id": media_id_sql(idc),
        "stories_id": idc,
        "url": f"'story/' || CAST({idc} AS STRING)",
        "byline_extracted_label": "coalesce(byline, '')",
        "is_correct": f"(CASE ({idc}) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'Y' ELSE 'y' END)",
        "byline_corrected": (f"(CASE ({idc}) % 3 WHEN 0 THEN upper(coalesce(byline, '')) "
                             f"WHEN 1 THEN coalesce(byline, '') || ' Jr' ELSE '' END)"),
        "n_names": f"CAST(({idc}) % 3 + 1 AS STRING)",
    }


def _build_eval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-label sheet rows, one per story page (header rows already dropped)."""
    b = _build_story_bylines(spark, sf_dir)
    return b.select(*[F.expr(v).alias(k) for k, v in _label_cols("stories_id").items()])


def eval_labels_sql() -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in _label_cols("stories_id").items())
    return f"(SELECT {cols} FROM {story_bylines_sql()} AS b)"


def gazetteer_rows() -> list[tuple]:
    """People names to look for in text: every first name with every surname."""
    return [(f"{f} {s}",) for f in FIRST_NAMES for s in SURNAMES]


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(gazetteer_rows(), "name string")


def gazetteer_sql() -> str:
    vals = ", ".join(f"({q(n)})" for (n,) in gazetteer_rows())
    return f"(SELECT * FROM (VALUES {vals}) AS t(name))"


# --- materialised inputs ------------------------------------------------------------
#
# The derived inputs are written once per session as parquet tables in the shared
# checkpoint folder and every query scans those tables, as it would scan the stored
# story/page tables of a deployment: filters and column pruning reach the parquet scan,
# and ``stories`` is partitioned by publish_month so month ranges prune partitions. Files follow
# from bytes: the splits of the page scan, and partitions of the advisory size for stories.

_MATERIALISED: dict[tuple, str] = {}

_LAYOUT = {
    "stories": ("publish_month", "media_id string, stories_id bigint, publish_date timestamp, url string, "
                                 "publish_month string"),
    "pages": ("publish_month", "stories_id bigint, html string, publish_month string"),
    "story_bylines": (None, "stories_id bigint, byline string"),
    "order_bylines": (None, "id bigint, media_id string, byline string"),
    "override_sheet": (None, "org string, name string, count bigint, gender string, row_no bigint"),
    "eval_labels": (None, "media_id string, stories_id bigint, url string, byline_extracted_label string, "
                          "is_correct string, byline_corrected string, n_names string"),
}


def _materialised(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import uuid

    from quillstat.session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    part, schema = _LAYOUT[name]
    path = _MATERIALISED.get(key)
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/derived-{uuid.uuid4().hex}/{name}"
        df = globals()[f"_build_{name}"](spark, sf_dir)
        if part == "publish_month":
            day = F.col("publish_date") if "publish_date" in df.columns else \
                F.expr(publish_date_sql("stories_id")).cast("timestamp")
            df = df.withColumn("publish_month", F.date_format(day, "yyyy-MM"))
            if name != "pages":  # pages are written where they are read: their HTML is not moved
                df = df.hint("rebalance", F.col("publish_month"))
            df.write.partitionBy("publish_month").parquet(path)
        else:
            df.write.parquet(path)
        _MATERIALISED[key] = path
    return spark.read.schema(schema).parquet(path)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story records (media_id, stories_id, publish_date, url, publish_month), one per driver page."""
    return _materialised(spark, sf_dir, "stories")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page HTML per story with the byline/section tags injected (stories_id, html)."""
    return _materialised(spark, sf_dir, "pages")


def story_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "story_bylines")


def order_bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "order_bylines")


def override_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "override_sheet")


def eval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "eval_labels")
