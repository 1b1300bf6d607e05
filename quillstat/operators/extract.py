"""Byline, section and opinion extraction from story pages.

Plan shape (one story = one row, no shuffle of HTML):

    stories ─┬─ broadcast ⋈ media (outlet)          (size-checked, ~10 rows)
             └─ ⋈ pages on stories_id (left)         (the only big join)
                 → page gate, then mapInArrow: ONE html.parser pass per page evaluates
                   the byline and section-tag rules in priority order
                 → native expressions: byline clean-up, section from URL
                   (rules compiled into a CASE over outlet), is_opinion,
                   full text (regex tag strip + tokens), gender counts.

Rules are data (``sources.rules``); they are shipped to tasks inside the
partition function's closure after a size check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions.text import _c, collapse_ws, strip_tags, strip_ws, token_string
from quillstat.operators import gate, htmldom
from quillstat.operators.joins import collect_small, small_side
from quillstat.sources import rules as R

# ---------------------------------------------------------------------------
# rule lookup helpers
# ---------------------------------------------------------------------------


def _rule_rows(rules_df: DataFrame | None) -> list[tuple]:
    if rules_df is None:
        return R.extractor_rule_rows()
    return [tuple(r) for r in collect_small(
        rules_df.select("outlet", "kind", "priority", "selector", "attr", "regex", "grp"))]


def _by_outlet(rows: list[tuple], kind: str) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for outlet, k, prio, sel, attr, rx, grp in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k == kind:
            out.setdefault(outlet, []).append((prio, sel, attr, rx, grp))
    return out


# ---------------------------------------------------------------------------
# X-3 section from URL, X-5 opinion flag, X-2 clean-up: native expressions
# ---------------------------------------------------------------------------


def section_from_url(outlet, url, rules_df: DataFrame | None = None) -> Column:
    """First URL rule of the outlet matching at the start → its group; null if none."""
    per = _by_outlet(_rule_rows(rules_df), "section_url")
    o, u = _c(outlet), _c(url)
    expr = None
    for name, lst in per.items():
        inner = None
        for _, _, _, rx, grp in lst:
            hit = F.when(u.rlike(rx), F.regexp_extract(u, rx, grp))
            inner = hit if inner is None else F.coalesce(inner, hit)
        expr = F.when(o == name, inner) if expr is None else expr.when(o == name, inner)
    return expr if expr is not None else F.lit(None).cast("string")


def is_opinion(outlet, section, compat: bool = False, labels: list[tuple] | None = None) -> Column:
    """Null if the outlet has no opinion labels or the section is ''; else whether the
    lower-cased section equals a lower-cased label. ``compat=True`` gives the old
    result (first character compared with the labels: never true)."""
    labels = labels if labels is not None else R.OPINION_LABELS
    per: dict[str, list[str]] = {}
    for o, lab in labels:
        per.setdefault(o, []).append(lab)
    o, s = _c(outlet), _c(section)
    has_labels = o.isin(list(per)) if per else F.lit(False)
    if compat:
        value = F.lit(False)
    else:
        value = None
        for name, labs in per.items():
            hit = F.lower(s).isin([x.lower() for x in labs])
            value = F.when(o == name, hit) if value is None else value.when(o == name, hit)
    return F.when(has_labels & s.isNotNull() & (F.length(s) > 0), value).otherwise(F.lit(None).cast("boolean"))


def clean_byline(col) -> Column:
    """Collapse whitespace, drop one leading 'BY '/'By '/'by ' (only when text follows), strip."""
    v = collapse_ws(_c(col))
    v = F.when(v.rlike("^(BY|By|by) ."), F.substring(v, 4, 1 << 30)).otherwise(v)
    return strip_ws(v)


# ---------------------------------------------------------------------------
# X-1 / X-2 / X-4 / X-8: the partition function
# ---------------------------------------------------------------------------

def _compile(per: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
    return {o: [(prio, htmldom.parse_selector(sel), attr, re.compile(rx) if rx else None, grp)
                for prio, sel, attr, rx, grp in lst] for o, lst in per.items()}


def _first_hit(page, compiled: list[tuple]):
    """(value, priority) of the first rule whose selector finds an element; (None, None) if none.
    A missing attribute raises KeyError, as the element lookup does in the source."""
    for prio, steps, attr, rx, grp in compiled:
        i = htmldom.select_first(page, steps)
        if i < 0:
            continue
        if attr:
            value = page.attrs[i][attr.lower()]
        else:
            value = page.text(i)
        if rx is not None:
            m = rx.match(value)
            if m:
                value = (m.group(grp) or "").strip()
        return value, prio
    return None, None


HIT_TYPE = T.ArrayType(T.StructType([
    T.StructField("outlet", T.StringType()),
    T.StructField("byline_value", T.StringType()),
    T.StructField("byline_rule", T.IntegerType()),
    T.StructField("section_value", T.StringType()),
    T.StructField("section_rule", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("section_error", T.StringType()),
]))


#: Pages whose hits a Python task holds at once; their texts are taken one by one.
PAGES_AT_ONCE = 256


def _scan(pages: DataFrame, html_col: str, candidates: Column, hit_type: T.ArrayType, make) -> DataFrame:
    """Pages → same rows without the HTML plus ``hits``. ``make()`` (once per task) gives a function of
    (html, candidate keys) that returns a list of hit dicts.

    Pages without candidates keep their row with no hits; their HTML does not leave the JVM. A task holds one
    page's text and the hits of ``PAGES_AT_ONCE`` pages beside the Arrow batch, whatever that batch's size."""
    keep = [f for f in pages.schema.fields if f.name != html_col]
    keys = pages.withColumn("_keys", candidates)
    asked = keys.select(*[F.col(f.name) for f in keep], F.when(F.size("_keys") > 0, F.col(html_col)).alias("_html"), "_keys")
    out = T.StructType(keep + [T.StructField("hits", hit_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work, arrow = make(), to_arrow_type(hit_type)
        for batch in batches:
            n = batch.num_columns
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                hits = [None if ks is None else work(html.as_py(), ks) if ks else []
                        for html, ks in zip(part.column(n - 2), part.column(n - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n - 2], pa.array(hits, arrow)], names=[f.name for f in out.fields])

    return asked.mapInArrow(run, out)


def _page_hits_fn(byline_rules: dict, section_rules: dict):
    def make():
        cb, cs = _compile(byline_rules), _compile(section_rules)

        def work(html: str, outlets: list[str]) -> list[dict]:
            try:
                page = htmldom.Page(html)
            except Exception as e:  # unparsable page: every outlet fails the same way
                return [{"outlet": o, "byline_value": None, "byline_rule": None, "section_value": None,
                         "section_rule": None, "error": type(e).__name__, "section_error": None} for o in outlets]
            hits = []
            for o in outlets:
                bv = br = sv = sr = err = section_err = None
                try:
                    bv, br = _first_hit(page, cb.get(o, []))
                except Exception as e:  # e.g. the chosen element lacks the attribute
                    err = type(e).__name__
                try:  # counts only where no URL rule gives the section
                    sv, sr = _first_hit(page, cs.get(o, []))
                except Exception as e:
                    section_err = type(e).__name__
                if any(x is not None for x in (br, sr, err, section_err)):  # absent = nothing found
                    hits.append({"outlet": o, "byline_value": bv, "byline_rule": br, "section_value": sv,
                                 "section_rule": sr, "error": err, "section_error": section_err})
            return hits
        return work
    return make


def _tag_rules(rules_df: DataFrame | None) -> tuple[dict, dict]:
    rows = _rule_rows(rules_df)
    return _by_outlet(rows, "byline"), _by_outlet(rows, "section_tag")


def page_hits(pages: DataFrame, rules_df: DataFrame | None = None, html_col: str = "html") -> DataFrame:
    """Pages → same rows without the HTML plus ``hits``: for every outlet with rules, the
    first byline and section-tag hit (null for a null page). A page is parsed once, where it is read, and only
    for outlets whose rules the page gate lets pass; only these small structs travel to the story join (the
    HTML is never shuffled)."""
    byline, section = _tag_rules(rules_df)
    return _scan(pages, html_col, gate.outlet_candidates(F.col(html_col), [byline, section]), HIT_TYPE, _page_hits_fn(byline, section))


def gate_report(pages: DataFrame, rules_df: DataFrame | None = None, html_col: str = "html") -> DataFrame:
    """One row: n_pages, n_parsed (pages that any rule can match) and n_tried (outlets tried on them)."""
    return gate.report(pages, gate.outlet_candidates(F.col(html_col), list(_tag_rules(rules_df))), html_col)


def pages_for(stories: DataFrame, pages: DataFrame, story_ids_bound: int | None,
              months: list[str] | None = None) -> DataFrame:
    """Only the pages that can belong to the given stories, chosen BEFORE the parse:

    * a story side with a proven size bound (a sample of n, a checked label sheet): broadcast
      semi join on the story id;
    * ``months`` known to the caller (a monthly job) and pages partitioned by
      ``publish_month``: a plain partition filter, so the scan reads those months only.
    Otherwise all pages are scanned and the join after the parse selects."""
    if story_ids_bound is not None:
        ids = small_side(stories.select("stories_id"), known_rows=story_ids_bound)
        pages = pages.join(ids, "stories_id", "left_semi")
    if months is not None and "publish_month" in pages.columns:
        pages = pages.where(F.col("publish_month").isin(list(months)))
    return pages


def months_between(start: str, end: str, closed: bool = False) -> list[str]:
    """'yyyy-MM' months touched by [start, end) (or [start, end] when closed)."""
    import datetime as dt
    a = dt.date.fromisoformat(start[:10])
    b = dt.date.fromisoformat(end[:10])
    if not closed and b.day == 1:
        b = b - dt.timedelta(days=1)
    out, y, m = [], a.year, a.month
    while (y, m) <= (b.year, b.month):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def with_outlet(stories: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Attach media_name/outlet by media_id (left join; unknown ids get null outlet)."""
    if media is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        media = small_side(R.media(spark), known_rows=len(R.MEDIA))
    else:
        media = small_side(media)
    return stories.join(media, "media_id", "left")


def extract_metadata(stories: DataFrame, pages: DataFrame, rules_df: DataFrame | None = None,
                     media: DataFrame | None = None, full_text: bool = False,
                     compat_opinion: bool = False, story_ids_bound: int | None = None,
                     months: list[str] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Stories ⋈ pages → byline, section, is_opinion (+ full_text) and a status per story.

    status: 'ok', or 'failed' (error holds the exception type; byline/section null).
    Unknown outlets and stories without a page give byline '' and section ''.
    ``labels``: opinion labels (outlet, label) in place of the shipped ones.

    The full text never passes through Python: it is made from the page in a branch of its own, which
    meets the hits on the story's key."""
    pg = pages_for(stories, pages, story_ids_bound, months)
    keyed = pg.select("stories_id", "html", *([F.xxhash64("html").alias("page_hash")] if full_text else []))
    texts = None
    if full_text:
        story_text = F.col("story_text") if "story_text" in pg.columns else F.lit(None).cast("string")
        made = pg.select("stories_id", F.xxhash64("html").alias("h"), full_text_col(story_text, F.col("html")).alias("t"))
        # one array per story (one text, as a rule), made where the story's key already is
        texts = made.repartition("stories_id").groupBy("stories_id").agg(F.collect_list(F.struct("h", "t")).alias("texts"))
    return articles_from_hits(stories, page_hits(keyed, rules_df), rules_df, media, texts, compat_opinion, labels)


def articles_from_hits(stories: DataFrame, hits: DataFrame, rules_df: DataFrame | None = None, media: DataFrame | None = None,
                       texts: DataFrame | None = None, compat_opinion: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """``extract_metadata`` from page hits (stories_id, hits) made before, e.g. a stored table that is bucketed like the stories.

    ``texts``: (stories_id, texts array<struct<h, t>>), with hits that carry ``page_hash``."""
    st = with_outlet(stories, media)
    out = st.join(hits, "stories_id", "left")
    extra = []
    if texts is not None:
        out = out.join(texts, "stories_id", "left")
        own = F.try_element_at(F.filter("texts", lambda t: t["h"].eqNullSafe(F.col("page_hash"))), F.lit(1))
        out = out.withColumn("full_text", own["t"])
        extra.append("full_text")
    hit = F.try_element_at(F.filter("hits", lambda h: h["outlet"] == F.col("outlet")), F.lit(1))
    out = out.select(*st.columns, *extra,
                     F.col("hits").isNotNull().alias("has_page"),
                     hit["byline_value"].alias("byline_value"), hit["byline_rule"].alias("byline_rule"),
                     hit["section_value"].alias("section_value"), hit["section_rule"].alias("section_rule"),
                     hit["error"].alias("byline_error"), hit["section_error"].alias("section_error"))
    url_section = section_from_url(F.col("outlet"), F.col("url"), rules_df)
    # section tags are looked at only when no URL rule matches, so only then can they fail a story
    out = out.withColumn("error", F.coalesce("byline_error", F.when(url_section.isNull(), F.col("section_error"))))
    failed = F.col("error").isNotNull()
    section = F.coalesce(url_section, F.col("section_value"), F.lit(""))
    byline = F.when(F.col("byline_value").isNull(), F.lit("")).otherwise(clean_byline("byline_value"))
    cols = [
        "media_id", "stories_id", "publish_date", "url", "media_name", "outlet",
        F.when(failed, None).otherwise(byline).alias("byline"),
        F.when(failed, None).otherwise(section).alias("section"),
        F.when(~failed, F.col("byline_rule")).alias("byline_rule"),
        F.col("section_value").alias("section_tag"), "section_rule",
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        "error", "has_page",
    ] + extra
    out = out.select(*cols)
    rows = None if labels is None else [tuple(r) for r in collect_small(labels.select("outlet", "label"))]
    return out.withColumn("is_opinion", F.when(F.col("status") == "ok",
                                               is_opinion("outlet", "section", compat_opinion, rows)))


def extract_with_fallback(stories: DataFrame, file_pages: DataFrame, archive_pages: DataFrame,
                          rules_df: DataFrame | None = None, max_broadcast_ids: int = 5_000_000) -> DataFrame:
    """P-3: extract from the stored file; when there is no file or it fails, from the story's
    archived page; when that fails too, the story is dropped.

    The first pass is checkpointed once (shared folder). Only the stories that need the
    second tier are looked up among the archived pages (semi join; the id side is broadcast
    when a bounded count allows), so those pages alone are parsed."""
    from quillstat.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(stories.sparkSession)
    first = extract_metadata(stories, file_pages, rules_df).checkpoint(eager=True)
    keep1 = first.where((F.col("status") == "ok") & F.col("has_page"))
    need = first.where((F.col("status") != "ok") | ~F.col("has_page")).select("stories_id")
    need = small_side(need, max_rows=max_broadcast_ids)
    again = stories.join(need, "stories_id", "left_semi")
    pages2 = archive_pages.select("stories_id", "html").join(need, "stories_id", "left_semi")
    second = extract_metadata(again, pages2, rules_df)
    keep2 = second.where((F.col("status") == "ok") & F.col("has_page"))
    return keep1.unionByName(keep2)


def full_text_col(story_text, html) -> Column:
    """X-10: tokens of the story text when known, else of the tag-stripped HTML."""
    return F.coalesce(F.when(_c(story_text).isNotNull(), token_string(story_text)),
                      F.when(_c(html).isNotNull(), token_string(strip_tags(html))))


# ---------------------------------------------------------------------------
# X-8 legacy rule table: first rule in file order whose tag is present
# ---------------------------------------------------------------------------

LEGACY_HIT_TYPE = T.ArrayType(T.StructType([
    T.StructField("media_id", T.StringType()),
    T.StructField("foundwith", T.StringType()),
    T.StructField("byline", T.StringType()),
    T.StructField("status", T.StringType()),
]))


def _legacy_fn(per_media: dict[str, list[tuple]]):
    def make():
        def work(html: str, media: list[str]) -> list[dict]:
            try:
                page = htmldom.Page(html)
            except Exception as e:
                return [{"media_id": m, "foundwith": None, "byline": None, "status": type(e).__name__} for m in media]
            hits = []
            for mid in media:
                f = b = None
                s = "Included not found"
                try:
                    for tag, attr, value in per_media[mid]:
                        i = htmldom.find_first(page, tag, attr, value)
                        if i >= 0:
                            b = page.attrs[i]["content"] if tag == "meta" else page.text(i)
                            f = f"{tag}[{attr}={value}]"
                            s = "found"
                            break
                except Exception as e:  # e.g. a meta tag without content
                    f = b = None
                    s = type(e).__name__
                if s != "Included not found":  # absent = nothing found for this media id
                    hits.append({"media_id": mid, "foundwith": f, "byline": b, "status": s})
            return hits
        return work
    return make


def legacy_hits(pages: DataFrame, per_media: dict[str, list[tuple]]) -> DataFrame:
    """(stories_id, hits): the first legacy rule found for every media id, behind the page gate."""
    return _scan(pages.select("stories_id", "html"), "html", gate.media_candidates(F.col("html"), per_media), LEGACY_HIT_TYPE, _legacy_fn(per_media))


def legacy_extract(stories: DataFrame, pages: DataFrame, legacy_rules: DataFrame | None = None,
                   story_ids_bound: int | None = None) -> DataFrame:
    """Stories ⋈ pages → (story columns, foundwith, byline, status). status is 'found',
    'Included not found', 'Not included' (media without rules) or an exception type.

    Pages are scanned where they are read, for every media id of the rule table that the page gate
    lets pass; only the small hit structs are joined to the stories."""
    if legacy_rules is None:
        rows = R.legacy_rule_rows()
    else:
        rows = [tuple(r) for r in collect_small(
            legacy_rules.select("media_id", "tag", "attr", "value", "priority"))]
    per: dict[str, list[tuple]] = {}
    for mid, tag, attr, value, prio in sorted(rows, key=lambda r: r[4]):
        per.setdefault(mid, []).append((tag, attr, value))
    hits = legacy_hits(pages_for(stories, pages, story_ids_bound), per)
    j = stories.join(hits, "stories_id", "left")
    hit = F.try_element_at(F.filter("hits", lambda h: h["media_id"] == F.col("media_id")), F.lit(1))
    has_rules = F.col("media_id").isin(list(per))
    return j.select(*stories.columns, hit["foundwith"].alias("foundwith"), hit["byline"].alias("byline"),
                    F.when(~has_rules | F.col("media_id").isNull(), F.lit("Not included"))
                    .otherwise(F.coalesce(hit["status"], F.lit("Included not found"))).alias("status"))


def route(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-2: (found rows, failed rows with reason) from one legacy result."""
    found = legacy.where(F.col("status") == "found").select("media_id", "url", "stories_id", "foundwith", "byline")
    failed = legacy.where(F.col("status") != "found").select("media_id", "url", "stories_id",
                                                             F.col("status").alias("reason"))
    return found, failed


def extraction_summary(legacy: DataFrame) -> DataFrame:
    """A-10: stories per (media_id, status, foundwith)."""
    return legacy.groupBy("media_id", "status", "foundwith").agg(F.count(F.lit(1)).alias("n_stories"))
