"""Container files, bucketed tables, month roll-ups and the stateless ingest."""

import glob
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillstat.operators import evaluate as E
from quillstat.operators import extract as X
from quillstat.operators import joins
from quillstat.operators import reports as RP
from quillstat.operators import rollups as RU
from quillstat.plans import derived as D
from quillstat.sources import bucketed, containers
from quillstat.streaming import ingest


def _tmp(name):
    return tempfile.mkdtemp(prefix=f"quillstat-{name}-", dir="/tmp") + "/x"


def _plan(df) -> str:
    mode = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


ODD = [None, "", "a", "\x1e", "\x1e\n", "x\x1eE\n\x1e", "E", "V", "N", "\n\r\n\t", "tab\tand\x1eEE", "日本 \U00010d45", "\x1e" * 3, "x" * 300_000, "7\tVx"]


def test_containers_keep_any_page(spark):
    rows = [(i, h) for i, h in enumerate(ODD)] + [(None, "no id"), (3, "again"), (-5, "neg")]
    out = _tmp("container")
    containers.write_page_container(spark.createDataFrame(rows, "stories_id long, html string").repartition(3), out)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, containers.read_page_container(spark, out).collect()), key=key) == sorted(rows, key=key)
    # the offset table leads to each record
    for r in containers.read_page_index(spark, out).collect():
        with open(re.sub("^file:(//)?", "", r["file"]), "rb") as f:
            f.seek(r["start"])
            record = f.read(r["length"] + len(containers.RECORD_END))
        assert record.endswith(b"\x1e\n") and record.split(b"\t")[0] == (b"" if r["stories_id"] is None else str(r["stories_id"]).encode())
    wanted = spark.createDataFrame([(4,), (3,), (99,), (4,), (None,)], "stories_id long")
    got = containers.read_pages_of(spark, out, wanted).collect()
    assert sorted(map(tuple, got), key=key) == sorted([(4, "\x1e\n"), (3, "\x1e"), (3, "again")], key=key)
    assert containers.read_pages_of(spark, out, wanted.where("stories_id = 99")).count() == 0


def test_containers_are_read_by_split_and_few(spark):
    out = _tmp("container")
    pages = D.pages(spark, SF_SMALL).select("stories_id", "html")
    containers.write_page_container(pages, out)
    assert len(glob.glob(f"{out}/pages/part-*")) <= 8 < pages.count()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        back = containers.read_page_container(spark, out)
        assert back.rdd.getNumPartitions() > 8
        assert back.exceptAll(pages).count() == pages.exceptAll(back).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    empty = _tmp("container")
    containers.write_page_container(pages.limit(0), empty)
    assert containers.read_page_container(spark, empty).count() == 0


def test_bucketed_tables_join_without_an_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = bucketed.bucketed_articles(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL), "t_bucketed", _tmp("bucketed"), 4)
        plan = _plan(a).split("\n\n")[0]
        assert "SortMergeJoin" in plan and not re.search(r"(?<!Broadcast)Exchange", plan) and "MapIn" not in plan, plan
        direct = X.extract_metadata(D.stories(spark, SF_SMALL), D.pages(spark, SF_SMALL))
        assert a.select(direct.columns).exceptAll(direct).count() == direct.exceptAll(a.select(direct.columns)).count() == 0
        counted = _plan(a.groupBy("stories_id").count()).split("\n\n")[0]
        assert not re.search(r"(?<!Broadcast)Exchange", counted)  # further grouping by story needs none either
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS t_bucketed_stories")
        spark.sql("DROP TABLE IF EXISTS t_bucketed_hits")


def _articles(spark):
    rows = []
    for i in range(600):
        person = ["Ada Moor", "Tom Olt and Ada Moor", "Ben Ash; Cy Day", None, ""][i % 5]
        rows.append((["a", "b", None][i % 3], i, f"2013-{1 + i % 12:02d}-0{1 + i % 9} 10:00:00", ["Opinion", "us/opinion", "arts", None][i % 4], person))
    df = spark.createDataFrame(rows, "media_name string, stories_id long, d string, section string, byline string")
    return df.withColumn("publish_date", F.to_timestamp("d")).drop("d")


def test_rollups_equal_the_direct_reports(spark):
    arts, out = _articles(spark), _tmp("rollups")
    RU.write_rollups(arts.where("month(publish_date) <= 6"), out)
    # months are replaced when they are written again, others are added
    RU.write_rollups(arts.where("month(publish_date) >= 6"), out)
    sections, people, sketches = (RU.read_rollup(spark, out, n) for n in (RU.SECTIONS, RU.PEOPLE, RU.SKETCHES))
    same = lambda a, b: sorted(map(tuple, a.select(b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(RU.section_counts(sections), RP.section_counts(arts))
    assert same(RU.outlet_totals(sections), RP.outlet_totals(arts))
    assert same(RU.opinion_sections(sections), RP.opinion_sections(arts))
    assert same(RU.byline_counts(people), RP.byline_counts(arts))
    assert same(RU.outlet_people(people), RP.outlet_people(arts))
    assert same(RU.outlet_people_estimate(sketches), RP.outlet_people(arts))  # few people: the sketch is exact
    part = RU.read_rollup(spark, out, RU.PEOPLE, ["2013-02", "2013-03"])
    assert same(RU.outlet_people(part), RP.outlet_people(arts.where("month(publish_date) in (2, 3)")))
    assert "PartitionFilters: [publish_month" in _plan(part).replace("isnotnull(publish_month", "publish_month") or "publish_month" in _plan(part).split("PartitionFilters:")[1].split("\n")[0]


def _drops(spark):
    rows = [("1", i % 40, f"201{i % 4}-0{1 + i % 3}-01", f"u{i % 40}") for i in range(120)]
    rows = [(m, i, f"201{i % 4}-0{1 + i % 3}-01", u) for m, i, _, u in rows] + [("2", 900, None, "none"), ("2", None, "2011-01-01", "no id")]
    df = spark.createDataFrame(rows, "media_id string, stories_id long, d string, url string")
    return df.withColumn("publish_date", F.to_timestamp("d")).select("media_id", "stories_id", "publish_date", "url")


def _same_as_stateful(spark, sink, src):
    want = {tuple(r) for r in spark.read.parquet(src).select("media_id", "stories_id", "publish_date", "url").collect()}
    got = [tuple(r) for r in ingest.stored_stories(spark, sink).select("media_id", "stories_id", "publish_date", "url").collect()]
    return len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_batches_store_each_story_once_in_any_order(spark, order):
    base, drops = _tmp("batches"), _drops(spark)
    for i in order:
        drops.where(F.coalesce(F.col("stories_id"), F.lit(0)) % 4 != i).coalesce(1).write.mode("append").parquet(f"{base}/src")
    for _ in range(2):  # run again: nothing new
        ingest.ingest_batches(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", max_files_per_trigger=1).awaitTermination()
        assert _same_as_stateful(spark, f"{base}/sink", f"{base}/src")
    drops.coalesce(1).write.mode("append").parquet(f"{base}/src")  # a late drop of known stories
    ingest.ingest_batches(spark, f"{base}/src", f"{base}/sink", f"{base}/ck").awaitTermination()
    assert _same_as_stateful(spark, f"{base}/sink", f"{base}/src")


def test_a_killed_batch_is_stored_again(spark):
    base, drops = _tmp("killed"), _drops(spark)
    first, second = drops.where("stories_id < 25"), drops.where("stories_id >= 10 or stories_id is null")
    drops.write.parquet(f"{base}/src")
    ingest.store_batch(first, 0, f"{base}/sink")
    # the second batch's attempt was stored, but its number not noted: it comes again, whole
    ingest.store_batch(second, 1, f"{base}/sink")
    ingest.store_batch(second, 1, f"{base}/sink")
    assert _same_as_stateful(spark, f"{base}/sink", f"{base}/src")
    # and the first one too, after the second
    ingest.store_batch(first, 0, f"{base}/sink")
    assert _same_as_stateful(spark, f"{base}/sink", f"{base}/src")


def test_a_batch_reads_its_own_months_only(spark):
    base = _tmp("months")
    ingest.store_batch(_drops(spark), 0, f"{base}/sink")
    stored = ingest.stored_stories(spark, f"{base}/sink").where(F.col("publish_month").isin(["2011-02"]) & (F.col("batch") != 5))
    line = _plan(stored).split("PartitionFilters:")[1].split("\n")[0]
    assert "publish_month" in line and "batch" in line
    seen = ingest._stored_months(spark, f"{base}/sink", ["2011-02", "1990-01"])
    assert {re.search("publish_month=([^/]*)/", f)[1] for f in seen.inputFiles()} == {"2011-02"} and seen.columns[-2:] == ["publish_month", "batch"]
    assert ingest._stored_months(spark, f"{base}/sink", ["1990-01"]) is None and ingest._stored_months(spark, f"{base}/sink", []) is None


def test_files_of_a_batch_do_not_follow_the_shuffle_partitions(spark):
    base = _tmp("files")
    _drops(spark).coalesce(1).write.parquet(f"{base}/src")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        ingest.ingest_batches(spark, f"{base}/src", f"{base}/sink", f"{base}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    folders = glob.glob(f"{base}/sink/publish_month=*/batch=0")
    assert len(folders) > 5 and all(len(glob.glob(f"{f}/part-*")) == 1 for f in folders)
    assert _same_as_stateful(spark, f"{base}/sink", f"{base}/src")


def test_broadcasts_are_checked_by_bytes(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("w"))
    broadcast = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert broadcast(joins.small_side(wide)) and not broadcast(joins.small_side(wide, max_bytes=50_000)) and not broadcast(joins.small_side(wide, max_rows=99))


def test_a_missing_correction_is_an_empty_text(spark):
    labels = spark.createDataFrame([("1", 1, "u", "x", "n", None, "1")],
                                   "media_id string, stories_id long, url string, byline_extracted_label string, is_correct string, byline_corrected string, n_names string")
    found = spark.createDataFrame([("1", 1, "Ada", 1, 0, 0)], "media_id string, stories_id long, byline string, female int, male int, unknown int")
    r = E.evaluate(labels, found).first()
    assert (r["actual_byline"], r["correct"], r["missing_text"]) == ("", "n", "")
