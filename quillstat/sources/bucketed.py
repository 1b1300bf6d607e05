"""Bucketed tables: stories, page hits and texts laid out by ``stories_id`` once, so that the joins on it
need no exchange.

One exchange at the write brings a bucket's rows into one task, which is the hash partitioning that
Spark uses for its joins, so every bucket is one file sorted by the key. Tables of the same number of
buckets are joined bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstat.operators import extract as X

KEY = "stories_id"


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = KEY) -> DataFrame:
    """``df`` as the bucketed table ``table`` (files under ``path``); returns the table."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def store_hits(pages: DataFrame, table: str, path: str, buckets: int, rules_df: DataFrame | None = None) -> DataFrame:
    """The page hits of all rules, parsed once and stored by story: (stories_id, hits)."""
    return write_bucketed(X.page_hits(pages.select(KEY, "html"), rules_df), table, path, buckets)


def extract_bucketed(spark: SparkSession, stories_table: str, hits_table: str, rules_df: DataFrame | None = None,
                     media: DataFrame | None = None) -> DataFrame:
    """``extract_metadata`` from a stories table and a hits table with the same buckets: no exchange."""
    return X.articles_from_hits(spark.table(stories_table), spark.table(hits_table), rules_df, media)


def bucketed_articles(stories: DataFrame, pages: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Stories and page hits stored as ``<name>_stories`` and ``<name>_hits`` and joined from there."""
    write_bucketed(stories, f"{name}_stories", f"{path}/stories", buckets)
    store_hits(pages, f"{name}_hits", f"{path}/hits", buckets)
    return extract_bucketed(stories.sparkSession, f"{name}_stories", f"{name}_hits")

