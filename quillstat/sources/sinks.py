"""Writers for the reference's outputs.

All writes are plain DataFrame writes (atomic per task via the output
committer), so a lost executor only re-runs its tasks. A result used by two
writes is checkpointed once to the cluster's shared checkpoint folder, never to
a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators.extract import route

ARTICLE_COLUMNS = ["media_id", "stories_id", "publish_date", "url", "byline", "female", "male", "unknown",
                   "section", "is_opinion", "full_text"]


def write_articles(articles: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   by_size: bool = False) -> None:
    """SNK-1 / SNK-4: article table partitioned by publish_month (partition pruning for
    month queries). CSV keeps the source's text form: 'None' for null. ``by_size``
    brings a month's rows together in files of the session's advisory partition size, large
    months in many (one exchange); without it each task writes its own rows (no shuffle)."""
    cols = [c for c in ARTICLE_COLUMNS if c in articles.columns]
    out = articles.select(*cols, F.date_format("publish_date", "yyyy-MM").alias("publish_month"))
    if by_size:
        out = out.hint("rebalance", F.col("publish_month"))
    w = out.write.mode(mode).partitionBy("publish_month")
    if fmt == "csv":
        w.option("header", True).option("nullValue", "None").option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_routed(legacy: DataFrame, found_path: str, failed_path: str, fmt: str = "csv") -> None:
    """SNK-2: one extraction, two outputs (found / failed with reason). The shared input
    is checkpointed once (reliable, shared folder) so the two writes do not re-extract."""
    spark = legacy.sparkSession
    from quillstat.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    once = legacy.checkpoint(eager=True)
    found, failed = route(once)
    for df, path in ((found, found_path), (failed, failed_path)):
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("escape", '"').csv(path)  # read_routed_results(header=True)
        else:
            w.parquet(path)


def append_run_log(spark: SparkSession, path: str, run_id: str) -> None:
    """SNK-3: append 'timestamp: run id' (one row per run)."""
    row = spark.range(1).select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                                         F.lit(": "), F.lit(run_id)).alias("value"))
    row.coalesce(1).write.mode("append").text(path)


def write_run_results(extracted: DataFrame, evaluated: DataFrame, path: str, run_id: str) -> None:
    """SNK-5: extraction results and evaluated results of one run, under run_id=<id>."""
    for name, df in (("extracted_results", extracted), ("evaluated_results", evaluated)):
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}"))
