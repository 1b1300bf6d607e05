"""Outlet reports over extracted articles.

Every report is a hash aggregation with map-side partial aggregation, so a hot
outlet (one key holding a third of the rows) is pre-combined in each map task
before the shuffle. Distinct counts are exact (two-phase: distinct on
(outlet, person), then count). Nothing is collected per group: mentioner
breakdowns are returned as flat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.names import full_names
from quillstat.operators.joins import small_side


def opinion_filter(section) -> Column:
    """'opinion' anywhere in the lower-cased section."""
    s = F.col(section) if isinstance(section, str) else section
    return F.coalesce(F.lower(s).contains("opinion"), F.lit(False))


def _sec(df: DataFrame) -> DataFrame:
    return df.withColumn("section", F.coalesce(F.col("section"), F.lit("")))


def section_counts(articles: DataFrame) -> DataFrame:
    """A-1: articles per (media_name, section)."""
    return _sec(articles).groupBy("media_name", "section").agg(F.count(F.lit(1)).alias("n_articles"))


def outlet_totals(articles: DataFrame) -> DataFrame:
    """A-2: per outlet, distinct sections ('' counts) and articles."""
    return (_sec(articles).groupBy("media_name")
            .agg(F.countDistinct("section").alias("n_sections"), F.count(F.lit(1)).alias("n_articles")))


def opinion_sections(articles: DataFrame) -> DataFrame:
    """A-3: the opinion sections of each outlet with their article counts."""
    return section_counts(articles.where(opinion_filter("section")))


def byline_people(articles: DataFrame) -> DataFrame:
    """Opinion articles exploded to one row per byline person (a person named twice counts twice)."""
    op = articles.where(opinion_filter("section"))
    return op.select("media_name", "stories_id", F.explode(full_names(F.col("byline"))).alias("person"))


def byline_counts(articles: DataFrame) -> DataFrame:
    """A-4: opinion articles per (outlet, byline person)."""
    return byline_people(articles).groupBy("media_name", "person").agg(F.count(F.lit(1)).alias("n_articles"))


def outlet_people(articles: DataFrame) -> DataFrame:
    """A-5: distinct byline people per outlet (exact)."""
    return byline_people(articles).groupBy("media_name").agg(F.countDistinct("person").alias("n_people"))


def gender_rollup(articles: DataFrame, by: list[str]) -> DataFrame:
    """A-11 roll-up: byline gender totals by the given keys (e.g. outlet and month)."""
    return articles.groupBy(*by).agg(
        F.sum("female").cast("long").alias("female"), F.sum("male").cast("long").alias("male"),
        F.sum("unknown").cast("long").alias("unknown"), F.count(F.lit(1)).alias("n_articles"))


def unmatched_media(stories: DataFrame, media: DataFrame) -> DataFrame:
    """J-2 check: stories whose media_id has no outlet (the source would raise)."""
    return stories.join(small_side(media.select("media_id").distinct()), "media_id", "left_anti")


def unmatched_report(stories: DataFrame, media: DataFrame) -> DataFrame:
    """J-2: (media_id, n_stories) of the outlets that have to be known but are not."""
    return unmatched_media(stories, media).groupBy("media_id").agg(F.count(F.lit(1)).alias("n_stories"))


def matched_articles(articles: DataFrame, media: DataFrame) -> DataFrame:
    """J-2: articles with the outlet name of their media id; others are left out (``unmatched_report`` lists them)."""
    names = small_side(media.select("media_id", F.col("media_name").alias("_name")))
    return articles.join(names, "media_id", "inner").withColumn("media_name", F.col("_name")).drop("_name")
