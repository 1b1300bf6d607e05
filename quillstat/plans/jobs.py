"""The reference's end-to-end flows, composed from the operators.

Each job is one Spark plan per output; nothing is looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators import evaluate as E
from quillstat.operators import extract as X
from quillstat.operators import gender as G
from quillstat.operators import mentions as M
from quillstat.operators import reports as RP
from quillstat.operators import sampling as S
from quillstat.operators.joins import small_side
from quillstat.session import ensure_checkpoint_dir
from quillstat.sources import readers, sinks


def _with_gender(articles: DataFrame, names: DataFrame) -> DataFrame:
    a = G.byline_gender(articles, names, key_cols=["stories_id"])
    ok = F.col("status") == "ok"
    return (a.withColumn("female", F.when(ok, F.col("female"))).withColumn("male", F.when(ok, F.col("male")))
            .withColumn("unknown", F.when(ok, F.col("unknown"))))


def monthly_articles(stories: DataFrame, pages: DataFrame, names: DataFrame, start: str, end: str,
                     media_ids: list[str] | None = None, out_path: str | None = None, fmt: str = "csv",
                     full_text: bool = True, closed: bool = False) -> DataFrame:
    """3.1: stories of a month (and outlets) → byline, gender counts, section, opinion flag,
    full text → month table (SNK-1). Failed stories keep their story columns only."""
    st = S.story_scan(stories, start, end, media_ids, closed=closed)
    months = X.months_between(start, end, closed)  # the page scan reads these months only
    arts = _with_gender(X.extract_metadata(st, pages, full_text=full_text, months=months), names)
    if out_path:
        # the pages are parsed once: the table is written, and the reports go on, from the checkpoint
        ensure_checkpoint_dir(stories.sparkSession)
        arts = arts.checkpoint(eager=True)
        sinks.write_articles(arts, out_path, fmt=fmt)
    return arts


def outlet_report(articles: DataFrame, mentions: DataFrame | None = None,
                  names: tuple[list[str], list[str]] | DataFrame | None = None) -> dict[str, DataFrame]:
    """3.3: section, opinion, byline-people and mentioned-people reports of one article table.
    ``names``: see ``gender.name_lookup``."""
    out = {
        "section_counts": RP.section_counts(articles),
        "outlet_totals": RP.outlet_totals(articles),
        "opinion_sections": RP.opinion_sections(articles),
        "byline_counts": RP.byline_counts(articles),
        "outlet_people": RP.outlet_people(articles),
    }
    if mentions is not None and names is not None:
        out["mentioned_people"] = M.mentioned_people(articles, mentions, names)
        out["mention_bylines"] = M.mention_bylines(articles, mentions)
    return out


def evaluation_run(spark: SparkSession, labels: DataFrame, stories: DataFrame, pages: DataFrame,
                   names: DataFrame, out_path: str, run_id: str) -> DataFrame:
    """3.2: extract the labelled stories, score them, write both result tables of the run
    and append the run log; returns the accuracy row."""
    ids = labels.select("stories_id").distinct()
    cap = 1_000_000
    n = ids.limit(cap + 1).count()  # hand labels: a small sheet
    bound = n if n <= cap else None
    st = stories.join(small_side(ids, known_rows=n) if bound else ids, "stories_id", "left_semi")
    ensure_checkpoint_dir(spark)
    arts = _with_gender(X.extract_metadata(st, pages, story_ids_bound=bound), names).checkpoint(eager=True)
    evaluated = E.evaluate(labels, arts)
    extracted = arts.select("media_id", "stories_id", "publish_date", "byline", "female", "male", "unknown",
                            "section", "is_opinion")
    sinks.write_run_results(extracted, evaluated, out_path, run_id)
    sinks.append_run_log(spark, f"{out_path}/run_log", run_id)
    written = spark.read.parquet(f"{out_path}/evaluated_results").where(F.col("run_id") == run_id)
    return E.accuracy(written)


def legacy_sample_run(spark: SparkSession, stories: DataFrame, pages: DataFrame, start: str, end: str,
                      media_set_members: DataFrame | None, n: int, out_path: str, run_id: str,
                      seed: int = 1) -> DataFrame:
    """Older flow: a repeatable sample of n stories (of a media set) → legacy rule table →
    found / failed files → run log. Returns the summary by media, status and rule."""
    st = S.story_scan(stories, start, end, closed=True)
    if media_set_members is not None:
        st = st.join(small_side(media_set_members.select("media_id")), "media_id", "left_semi")
    sample = S.sample_stories(st, n, seed)
    ensure_checkpoint_dir(spark)
    # only the sampled pages are parsed, once
    leg = X.legacy_extract(sample, pages, story_ids_bound=n).checkpoint(eager=True)
    sinks.write_routed(leg, f"{out_path}/{run_id}/extracted_bylines", f"{out_path}/{run_id}/failed_bylines")
    sinks.append_run_log(spark, f"{out_path}/run_log", run_id)
    return X.extraction_summary(leg)


def file_mode(spark: SparkSession, story_list_path: str, pages_dir: str, archive_pages: DataFrame,
              names: DataFrame) -> DataFrame:
    """'file' mode: a story list CSV (SRC-5) names stored page files (SRC-4); each story is
    extracted from its file, else from the archived page, else dropped (P-3)."""
    lst = readers.read_story_list(spark, story_list_path)
    stories = lst.select("media_id", "stories_id", F.to_timestamp("publish_date").alias("publish_date"), "url")
    files = readers.read_page_files(spark, pages_dir)
    return _with_gender(X.extract_with_fallback(stories, files, archive_pages), names)
