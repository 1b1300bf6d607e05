"""Streaming ingest keeps each story once, like the batch dedup."""

import tempfile

from pyspark.sql import functions as F

from quillstat.streaming import ingest


def test_stream_dedups_overlapping_drops(spark):
    base = tempfile.mkdtemp(prefix="quillstat-stream-", dir="/tmp")
    rows = [("1", i, f"2013-0{8 + i % 2}-01 00:00:00", f"u{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "media_id string, stories_id long, publish_date string, url string") \
        .withColumn("publish_date", F.to_timestamp("publish_date"))
    df.write.parquet(f"{base}/src/drop=a")
    df.where(F.col("stories_id") < 10).write.parquet(f"{base}/src/drop=b")  # overlap
    q = ingest.ingest(spark, f"{base}/src/*", f"{base}/sink", f"{base}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/sink")
    assert out.count() == 20
    assert out.select("stories_id").distinct().count() == 20
