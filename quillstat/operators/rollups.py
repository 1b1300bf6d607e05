"""Month roll-ups: partial aggregates of the article reports that add up (A-1 … A-5).

Per month one small table of sections and one of opinion byline people are stored, partitioned by
``publish_month``; writing a month again replaces it. Any span of months is then reported from
these rows: counts are sums, distinct sets are merged exactly from their members, or
estimated from a mergeable sketch of each month's people.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators.reports import byline_people, opinion_filter

SECTIONS, PEOPLE, SKETCHES = "sections", "people", "people_sketches"


def month_rollups(articles: DataFrame) -> dict[str, DataFrame]:
    """The three tables, each with ``publish_month`` (from ``publish_date``): sections (media_name, section,
    n_articles), people (media_name, person, n_articles), people_sketches (media_name, sketch)."""
    dated = articles.withColumn("publish_month", F.date_format("publish_date", "yyyy-MM")).withColumn("section", F.coalesce("section", F.lit("")))
    by_outlet = dated.withColumn("media_name", F.struct("publish_month", "media_name"))  # a person counts within month and outlet
    people = byline_people(by_outlet).select("media_name.publish_month", "media_name.media_name", "person")
    counted = people.groupBy("publish_month", "media_name", "person").agg(F.count(F.lit(1)).alias("n_articles"))
    return {SECTIONS: dated.groupBy("publish_month", "media_name", "section").agg(F.count(F.lit(1)).alias("n_articles")),
            PEOPLE: counted,
            SKETCHES: people.groupBy("publish_month", "media_name").agg(F.hll_sketch_agg("person").alias("sketch"))}


def write_rollups(articles: DataFrame, path: str) -> None:
    """Store the roll-ups of the months that ``articles`` hold whole; these months are replaced, others stay."""
    for name, table in month_rollups(articles).items():
        (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("publish_month").parquet(f"{path}/{name}"))


def read_rollup(spark: SparkSession, path: str, name: str, months: list[str] | None = None) -> DataFrame:
    """A stored roll-up; ``months`` prunes the scan."""
    table = spark.read.parquet(f"{path}/{name}").withColumn("publish_month", F.col("publish_month").cast("string"))
    return table if months is None else table.where(F.col("publish_month").isin(list(months)))


def section_counts(sections: DataFrame) -> DataFrame:
    """A-1 from the section roll-up."""
    return sections.groupBy("media_name", "section").agg(F.sum("n_articles").alias("n_articles"))


def outlet_totals(sections: DataFrame) -> DataFrame:
    """A-2 from the section roll-up."""
    return section_counts(sections).groupBy("media_name").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_articles").alias("n_articles"))


def opinion_sections(sections: DataFrame) -> DataFrame:
    """A-3 from the section roll-up."""
    return section_counts(sections.where(opinion_filter("section")))


def byline_counts(people: DataFrame) -> DataFrame:
    """A-4 from the people roll-up."""
    return people.groupBy("media_name", "person").agg(F.sum("n_articles").alias("n_articles"))


def outlet_people(people: DataFrame) -> DataFrame:
    """A-5 from the people roll-up, exact."""
    return byline_counts(people).groupBy("media_name").agg(F.count(F.lit(1)).alias("n_people"))


def outlet_people_estimate(sketches: DataFrame) -> DataFrame:
    """A-5 estimated from the months' sketches."""
    return sketches.groupBy("media_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_people"))
