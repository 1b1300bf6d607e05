"""Incremental story ingest (re-aim of the paged, month-by-month acquisition loop).

Story drops (parquet files) arriving in a folder are read as a stream, each
story is kept once even when month ranges overlap (closed ranges share the
midnight of the 1st), and the stories are written out. Story ids are kept as state for
the whole run, so drops may come in any date order and no late story is lost; a bounded
state (``watermark``) is an option for feeds known to be in date order.

``ingest_batches`` keeps no state at all: each micro-batch is compared with the stored stories of its
own months, so what it reads grows with the months a drop touches and not with the feed's age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstat.sources.readers import STORY_SCHEMA


def story_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(STORY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def dedup_stories(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each story id once. With ``watermark`` ids older than it are forgotten, and rows that
    late are dropped."""
    if watermark is None:
        return stream.dropDuplicates(["stories_id"])
    return stream.withWatermark("publish_date", watermark).dropDuplicatesWithinWatermark(["stories_id"])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
           watermark: str | None = None, max_files_per_trigger: int | None = 1000,
           state_partitions: int | None = None, state_store: str | None = ROCKSDB) -> StreamingQuery:
    """Run the ingest over everything available now (restartable from its checkpoint).

    The dedup state (all story ids seen) can be billions of keys: by default it
    lives in the RocksDB state store (off the JVM heap, incremental checkpoints).
    ``state_partitions`` fixes the number of state partitions of a NEW query (both settings
    are recorded in the checkpoint; a restarted query keeps its own)."""
    s = dedup_stories(story_stream(spark, source_dir, max_files_per_trigger), watermark)
    w = (s.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True))
    settings = {}
    if state_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    if state_store is not None:
        settings["spark.sql.streaming.stateStore.providerClass"] = state_store
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return w.start()  # the stream runs on a clone of the session taken here
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


STORED_SCHEMA = "media_id string, stories_id long, publish_date timestamp, url string, publish_month string, batch long"


def stored_stories(spark: SparkSession, sink_dir: str) -> DataFrame:
    """What ``ingest_batches`` has stored, with its ``publish_month`` and ``batch``."""
    return spark.read.schema(STORED_SCHEMA).parquet(sink_dir)


def _stored_months(spark: SparkSession, sink_dir: str, months: list[str]) -> DataFrame | None:
    """The stored stories of ``months``, whose folders alone are listed; None where none is stored."""
    paths = [p for p in (f"{sink_dir}/publish_month={m}" for m in months) if _there(spark, p)]
    return spark.read.schema(STORED_SCHEMA).option("basePath", sink_dir).parquet(*paths) if paths else None


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def store_batch(batch: DataFrame, number: int, sink_dir: str) -> None:
    """Add a batch's new stories to the stored month table (``publish_month=.../batch=<number>``).

    A story id is new when no other batch has stored it in its month (a story has one date; without one
    its month is ``none``). Each id comes once, also within the batch: the row with the smallest date, then outlet, then
    URL. Storing the same batch again, after a kill at any point, gives the same rows: its own rows are not
    compared with, and replace what a former attempt has left. Files follow from bytes (one exchange by month, with
    large months in many files), not from the session's number of shuffle partitions."""
    spark = batch.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")  # a stream's session has it off; this is a batch job
    try:
        month = F.coalesce(F.date_format("publish_date", "yyyy-MM"), F.lit("none"))
        first = (batch.groupBy("stories_id").agg(F.min(F.struct("publish_date", "media_id", "url")).alias("s"))
                 .select("s.media_id", "stories_id", "s.publish_date", "s.url").withColumn("publish_month", month))
        stored = _stored_months(spark, sink_dir, [r[0] for r in batch.select(month).distinct().collect()])  # the months of one drop
        if stored is not None:
            same = F.col("new.publish_month").eqNullSafe(F.col("old.publish_month")) & F.col("new.stories_id").eqNullSafe(F.col("old.stories_id"))
            others = stored.where(F.col("batch") != number).select("stories_id", "publish_month")
            first = first.alias("new").join(others.alias("old"), same, "left_anti")
        (first.withColumn("batch", F.lit(number).cast("long")).hint("rebalance", F.col("publish_month")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("publish_month", "batch").parquet(sink_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def ingest_batches(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                   max_files_per_trigger: int | None = 1000) -> StreamingQuery:
    """Ingest all drops available now without dedup state (restartable from its checkpoint)."""
    return (story_stream(spark, source_dir, max_files_per_trigger).writeStream
            .foreachBatch(lambda batch, number: store_batch(batch, number, sink_dir))
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
