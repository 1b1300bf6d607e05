"""Cases that earlier rounds got wrong."""

import os
import tempfile

from pyspark.sql import functions as F

from quillstat.operators import extract as X
from quillstat.operators import gender as G
from quillstat.operators import htmldom
from quillstat.operators import mentions as M
from quillstat.operators import sampling as S
from quillstat.sources import readers, sinks
from quillstat.streaming import ingest


def test_unclosed_paragraphs_end():
    page = htmldom.Page('<div><p class="byline">By Ada Moor<p>Body text<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></div>')
    assert page.text(htmldom.find_first(page, "p", "class", "byline")) == "By Ada Moor"
    assert [page.text(i) for i in page.by_tag["li"]] == ["one", "two"]
    assert [page.text(i) for i in page.by_tag["td"]] == ["a", "b", "c"]
    assert [page.text(i) for i in page.by_tag["tr"]] == ["ab", "c"]


def test_large_ids_sample(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 4_000_000_000, 9_000_000_000_000_000_000)], "stories_id long")
    got = [r[0] for r in S.sample_stories(rows, 3).collect()]
    assert got == sorted(got, key=lambda i: ((i * S.MIX_MULT + 1) % S.MIX_MOD, i))


def test_gender_paths_agree(spark):
    names = spark.createDataFrame([("Mira", "female"), ("mira", "female"), ("Lesley", "male"), ("lesley", "female"), ("Tom", "male")],
                                  "first_name string, gender string")
    rows = spark.createDataFrame([(1, "Mira Olt"), (2, "Lesley Olt"), (3, "Tom Olt and Zed Olt"), (3, "Mira Olt"), (4, None), (5, "")],
                                 "id int, byline string")
    a = sorted(map(tuple, G.byline_gender(rows, names).collect()), key=str)
    b = sorted(map(tuple, G.byline_gender(rows, names, max_inline=0).collect()), key=str)
    assert a == b
    assert (2, "Lesley Olt", 0, 0, 1) in a and (1, "Mira Olt", 1, 0, 0) in a


def test_name_lookup_forms_agree(spark):
    names = spark.createDataFrame([("Mira", "female"), ("Lesley", "male"), ("lesley", "female"), ("Tom", "male"), (None, "male")],
                                  "first_name string, gender string")
    people = spark.createDataFrame([(i, p) for i, p in enumerate(["Mira Olt", "Lesley Olt", "Tom", " ", "", None, "Míra Olt", "Zed Olt", "Tom"])],
                                   "id int, person string")
    for fold in (False, True):
        forms = [G.name_lookup(names), G.name_lookup(names, 0)]
        assert isinstance(forms[0], tuple) and forms[1] is names
        a, b = (sorted((r["id"], r["gender"]) for r in G.with_gender(people, F.col("person"), f, fold=fold).collect()) for f in forms)
        assert a == b and a[0] == (0, "female") and a[1] == (1, "unknown") and a[6][1] == ("female" if fold else "unknown")


def test_gazetteer_forms_agree(spark):
    docs = spark.createDataFrame([(1, "Ada Moor met Tom Olt and Ada Moor"), (2, None), (3, "nobody"), (4, "Tom Olt Junior came")],
                                 "stories_id long, full_text string")
    people = spark.createDataFrame([("Ada Moor",), ("Tom Olt",), ("Tom Olt Junior",), ("Ada Moor",)], "name string")
    forms = [sorted(map(tuple, M.gazetteer_mentions(docs, people, max_inline=n).collect())) for n in (500, 0)]
    assert forms[0] == forms[1] == [(1, "Ada Moor", 2), (1, "Tom Olt", 1), (4, "Tom Olt", 1), (4, "Tom Olt Junior", 1)]


def test_large_name_table_and_gazetteer(spark):
    n = 60_000
    names = spark.range(n).select(F.concat(F.lit("Nam"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("first_name"),
                                  F.when(F.col("id") % 2 == 0, "female").otherwise("male").alias("gender"))
    lookup = G.name_lookup(names)
    people = spark.createDataFrame([("Namc Olt",), ("Namd Olt",), ("Zed Olt",)], "person string")
    got = {r["person"]: r["gender"] for r in G.with_gender(people, F.col("person"), lookup).collect()}
    assert got == {"Namc Olt": "female", "Namd Olt": "male", "Zed Olt": "unknown"}
    docs = spark.createDataFrame([(1, "Namc Olt and Namc Olt")], "stories_id long, full_text string")
    people = names.select(F.concat("first_name", F.lit(" Olt")).alias("name"))
    assert [tuple(r) for r in M.gazetteer_mentions(docs, people).collect()] == [(1, "Namc Olt", 2)]


def test_sheet_rows_follow_file_order(spark):
    base = tempfile.mkdtemp(prefix="sheet-order-")
    for part, (gender, more) in enumerate((("female", 400), ("male", 0))):  # the larger file first
        with open(os.path.join(base, f"part-{part}.csv"), "w") as f:
            f.write("org,name,note,count,gender\n" + "".join(f"o,n{i},x,1,male\n" for i in range(more)) + f"o,Ada,x,1,{gender}\n")
    rows = G.clean_overrides(readers.read_override_sheet(spark, base)).where("name = 'Ada'").collect()
    assert [r["gender"] for r in rows] == ["male"]


def test_out_of_order_drops_are_kept(spark):
    base = tempfile.mkdtemp(prefix="drops-")
    for i, day in enumerate(("2014-06-01", "2010-01-01", "2012-03-01", "2010-01-01")):
        (spark.createDataFrame([("1", min(i, 2), f"{day}", "u")], "media_id string, stories_id long, publish_date string, url string")
         .withColumn("publish_date", F.to_timestamp("publish_date")).coalesce(1).write.mode("append").parquet(f"{base}/in"))
    for _ in range(2):
        ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ck", max_files_per_trigger=1, state_partitions=2,
                      state_store=None).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{base}/out").select("stories_id").collect()) == [0, 1, 2]


def test_section_error_counts_only_without_a_url_section(spark):
    html = '<meta name="author" content="Ada Moor"><meta name="CG">'
    url = "http://www.nytimes.com/2014/01/02/world/asia/x.html"
    st = spark.createDataFrame([("1", 1, url), ("1", 2, "http://x/y")], "media_id string, stories_id long, url string")
    st = st.withColumn("publish_date", F.lit(None).cast("timestamp"))
    pages = spark.createDataFrame([(1, html, "story text words"), (2, html, None)], "stories_id long, html string, story_text string")
    got = {r["stories_id"]: r for r in X.extract_metadata(st, pages, full_text=True).collect()}
    assert (got[1]["status"], got[1]["byline"], got[1]["section"]) == ("ok", "Ada Moor", "world/asia")
    assert (got[2]["status"], got[2]["error"], got[2]["byline"]) == ("failed", "KeyError", None)
    assert got[1]["full_text"] == "story text words"


def test_routed_files_come_back(spark):
    rows = spark.createDataFrame([("1", "u1", 1, "p[class=byline]", 'By "Ada"\nMoor', "found"), ("2", "u2", 2, None, None, "Not included")],
                                 "media_id string, url string, stories_id long, foundwith string, byline string, status string")
    base = tempfile.mkdtemp(prefix="routed-")
    sinks.write_routed(rows, f"{base}/found", f"{base}/failed")
    got = sorted(map(tuple, readers.read_routed_results(spark, f"{base}/found", f"{base}/failed", header=True).collect()))
    assert got == [("1", "u1", 1, "p[class=byline]", 'By "Ada"\nMoor', "found"), ("2", "u2", 2, None, None, "Not included")]


def test_sheets_with_any_line_end_and_quoted_breaks(spark):
    base = tempfile.mkdtemp(prefix="sheets-")
    for name, end in (("cr", "\r"), ("lf", "\n"), ("crlf", "\r\n")):
        with open(os.path.join(base, name), "w", newline="") as f:
            f.write(end.join(["media_id,tag,attr,attr", "1,meta,name,author\t", "2,p,class,byline"]) + end)
        rules = readers.read_legacy_rules(spark, os.path.join(base, name)).drop("priority").collect()
        assert sorted(map(tuple, rules)) == [("1", "meta", "name", "author"), ("2", "p", "class", "byline")], name
    with open(os.path.join(base, "labels.csv"), "w", newline="") as f:
        f.write('h\nh\n1,5,u,x,"By ""Ada""\nMoor",y,,x,1\n1,bad,u,x,b,n,,x,1\n')
    got = sorted((r["stories_id"] is None, r["stories_id"], r["byline_extracted_label"])
                 for r in readers.read_eval_labels(spark, os.path.join(base, "labels.csv")).collect())
    assert got == [(False, 5, 'By "Ada"\nMoor'), (True, None, "b")]
