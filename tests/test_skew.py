"""A hot key (one outlet and one byline person holding a third of the rows) is
pre-aggregated map-side and counted exactly; no row is dropped."""

from pyspark.sql import functions as F

from quillstat.operators import reports as RP


def test_hot_person_counts_exact_and_partial(spark):
    n = 3000
    others = ["Ann Lee", "Bo Yi", "Cy Day", "Di Fox", "Ed Gee", "Flo Hu", "Gus Ivy"]
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append(("wire" if hot else f"outlet{i % 7}", i, "Associated Press" if hot else others[i % 7],
                     "opinion"))
    arts = spark.createDataFrame(rows, "media_name string, stories_id long, byline string, section string")
    counts = {(r.media_name, r.person): r.n_articles for r in RP.byline_counts(arts).collect()}
    assert counts[("wire", "associated press")] == n // 3
    assert sum(counts.values()) == n
    jvm = spark.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = RP.byline_counts(arts)._jdf.queryExecution().explainString(mode)
    assert "partial_count" in plan  # map-side combine before the exchange
    assert RP.outlet_people(arts).where(F.col("media_name") == "wire").first().n_people == 1
