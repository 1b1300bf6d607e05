"""Stored pages in container files: many pages a file, read by split, with an offset table.

A container is a text file of records ``<stories_id>\\t<V|N><html>``, ended by ``RECORD_END``. The one
character that can begin a record's end is doubled up with a letter inside pages, so a page never
holds one and any reader can start at a split. A task writes one file, so the number of files follows
from the bytes of the page scan's splits, not from the number of pages.

The offset table (``index/``: stories_id, file, start, length in bytes) tells which file holds a page and
where; ``read_pages_of`` opens only the files that hold the pages asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.operators.joins import small_side

RECORD_END = "\x1e\n"
_MARK, _KEPT = "\x1e", "\x1eE"
#: File names that ``read_pages_of`` may list; more pages' files are read as a whole.
MAX_FILES = 10_000


def _record(stories_id: Column, html: Column) -> Column:
    return F.concat(F.coalesce(stories_id.cast("string"), F.lit("")), F.lit("\t"),
                    F.when(html.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.replace(html, F.lit(_MARK), F.lit(_KEPT)))))


def write_page_container(pages: DataFrame, path: str) -> None:
    """``pages`` (stories_id, html) as container files under ``path``/pages and their offset table under
    ``path``/index. The pages are not moved; a folder that is there is an error."""
    spark = pages.sparkSession
    records = pages.select(_record(F.col("stories_id"), F.col("html")).alias("value"))
    records.write.option("lineSep", RECORD_END).text(f"{path}/pages")
    # a file's records in order: its splits by their start, a split's rows as they are read
    read = _records(spark, f"{path}/pages").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    sized = read.select("file", "block", F.monotonically_increasing_id().alias("row"), _id(F.col("value")).alias("stories_id"),
                        F.octet_length("value").cast("long").alias("length"))
    before = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") + len(RECORD_END)).over(before), F.lit(0))
    sized.select("stories_id", "file", start.alias("start"), "length").write.parquet(f"{path}/index")


def _records(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("lineSep", RECORD_END).text(paths)


def _id(value: Column) -> Column:
    return F.substring_index(value, "\t", 1).try_cast("long")


def _pages(records: DataFrame) -> DataFrame:
    body = F.substr("value", F.instr("value", "\t") + F.lit(1))
    html = F.when(body.startswith("V"), F.replace(F.substr(body, F.lit(2)), F.lit(_KEPT), F.lit(_MARK)))
    return records.select(_id(F.col("value")).alias("stories_id"), html.alias("html"))


def read_page_container(spark: SparkSession, path: str) -> DataFrame:
    """All stored pages: (stories_id, html)."""
    return _pages(_records(spark, f"{path}/pages"))


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset table: (stories_id, file, start, length)."""
    return spark.read.parquet(f"{path}/index")


def read_pages_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The stored pages of ``ids`` (stories_id): the offset table names the files that hold them."""
    ids = ids.select("stories_id").distinct()
    wanted = small_side(ids)
    files = [r["file"] for r in read_page_index(spark, path).join(wanted, "stories_id", "left_semi").select("file").distinct().limit(MAX_FILES + 1).collect()]
    if not files:
        return read_page_container(spark, path).where(F.lit(False))
    pages = _pages(_records(spark, files)) if len(files) <= MAX_FILES else read_page_container(spark, path)
    return pages.join(wanted, "stories_id", "left_semi")
