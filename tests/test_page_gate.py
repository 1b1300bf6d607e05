"""The page gate hides nothing: hits behind it equal those of every rule tried on every page."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillstat.operators import extract as X
from quillstat.plans import derived as D
from quillstat.sources import rules as R


def _plain(value, rng):
    """A value as it can be written in HTML: plain, or with references that decode to it."""
    out = []
    for c in value:
        how = rng.random()
        out.append(c if how < 0.9 else rng.choice([f"&#{ord(c)};", f"&#x{ord(c):x};", f"&#X{ord(c):04X};", f"&#0{ord(c)};", f"&#{ord(c)}", f"{c}&#1;"]))
    return "".join(out).replace(".", rng.choice([".", "&period;"])).replace("_", rng.choice(["_", "&lowbar;"]))


def _element(tag, attr, value, rng):
    v = value if rng.random() < 0.6 else _plain(value, rng)
    if attr == "class" and rng.random() < 0.5:
        v = rng.choice(["x", "x y", "xbyline", "by-line"]) + rng.choice([" ", "\n", "&nbsp;", "&nbsp", "&#32;", "&#32", "\xa0", "-", ""]) + v + rng.choice(["", " z", "&#160;z", "z"])
    v = v + rng.choice(["", "", "", "x", "-x", " "])
    eq = rng.choice(["=", "=", " = ", "==", "=\xa0", "\n=\n", "= "])
    quote = rng.choice(['"', '"', "'", ""])
    name = rng.choice([attr, attr.upper(), attr.title()])
    spelled = rng.choice([tag, tag.upper()]).replace("k", rng.choice(["k", "K"]))
    content = rng.choice(["", ' content="By Ada Moor"', ' content="x>y"', " CONTENT=Opinion"])
    return f"<{spelled} {name}{eq}{quote}{v}{quote}{content}>" + rng.choice(["By Ada Moor", "Opinion", "a < b"]) + rng.choice([f"</{tag}>", ""])


def _pages(n, seed):
    rng = random.Random(seed)
    steps = []
    for _, sel, *_ in [*R.BYLINE_RULES, *R.SECTION_TAG_RULES]:
        steps += [s for s in X.htmldom.parse_selector(sel.replace(", ", ","))]
    finds = [(t, a, v) for _, t, a, v in R.LEGACY_RULES]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                tag, attr, _, value = rng.choice(steps)
                parts.append(_element(tag, attr, value, rng) if attr else f"<{tag}>x")
            else:
                parts.append(_element(*rng.choice(finds), rng))
        parts.append(rng.choice(["", "", "author byline", "<![if !IE]>", "<![endif]-->", "<![foo[", "<![ x", "<!x", "<!--", "<script>", "&nbsp;", "&#8217;", "="]))
        rng.shuffle(parts)
        out.append("<html>" + " ".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_behind_the_gate_are_all_hits(spark, seed):
    pages = [None, "", *_pages(1500, seed)]
    df = spark.createDataFrame(list(enumerate(pages)), "stories_id long, html string").repartition(4)
    byline, section = X._tag_rules(None)
    outlets = sorted(set(byline) | set(section))
    work = X._page_hits_fn(byline, section)()
    got = {r["stories_id"]: r["hits"] for r in X.page_hits(df).collect()}
    n_hits = 0
    for i, html in enumerate(pages):
        want = None if html is None else work(html, outlets)
        mine = got[i] if got[i] is None else [h.asDict() for h in got[i]]
        assert mine == want, html
        n_hits += bool(want)
    assert n_hits > 300
    per = {}
    for mid, tag, attr, value, _ in R.legacy_rule_rows():
        per.setdefault(mid, []).append((tag, attr, value))
    work = X._legacy_fn(per)()
    got = {r["stories_id"]: r["hits"] for r in X.legacy_hits(df, per).collect()}
    for i, html in enumerate(pages):
        mine = got[i] if got[i] is None else [h.asDict() for h in got[i]]
        assert mine == (None if html is None else work(html, list(per))), html
    n, parsed, tried = X.gate_report(df).first()
    assert n == len(pages) - 1 and n_hits <= parsed < n and tried < parsed * len(outlets)


def test_rules_without_values_and_user_rules(spark):
    rules = spark.createDataFrame([("o1", "byline", 1, "h1", None, None, 0), ("o2", "byline", 1, 'link[rel="me"] b', None, None, 0),
                                   ("o3", "section_tag", 1, "link", "href", None, 0), ("o4", "byline", 1, 'i[id=""]', None, None, 0)], R.RULE_SCHEMA)
    pages = ["<H1>Ada", "<h2>", "<linK href=x>", "<link rel=me><b>Ada</b>", "<i id>x</i>", "<i id=''>x", "text", "<h1"]
    df = spark.createDataFrame(list(enumerate(pages)), "stories_id long, html string")
    byline, section = X._tag_rules(rules)
    work = X._page_hits_fn(byline, section)()
    got = {r["stories_id"]: [h.asDict() for h in r["hits"]] for r in X.page_hits(df, rules).collect()}
    assert got == {i: work(p, ["o1", "o2", "o3", "o4"]) for i, p in enumerate(pages)} and got[0] and got[2]


def test_gated_pages_do_not_reach_python(spark):
    """Their HTML is null at the Python node; raw pages without rule tags are not parsed."""
    raw = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select(F.col("page_id").alias("stories_id"), "html")
    n, parsed, _ = X.gate_report(raw).first()
    assert n == raw.count()
    injected = X.gate_report(D.pages(spark, SF_SMALL)).first()
    assert parsed < n and injected["n_parsed"] > parsed
    plan = X.page_hits(raw)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_a_task_holds_one_page_text_and_few_hits_at_once(spark):
    # 40 MB in Arrow; a character beyond 16 bits makes each text four times as long in Python
    pages = spark.range(0, 2000, 1, 1).select(F.col("id").alias("stories_id"), F.concat(F.repeat(F.lit("x"), 20_000), F.lit("\U0001f600")).alias("html"))

    def make():
        import tracemalloc
        tracemalloc.start()

        def work(html, keys):
            kb = tracemalloc.get_traced_memory()[0] // 1000
            hit = dict.fromkeys(("byline_value", "section_value", "section_rule", "error", "section_error"))
            return [{"outlet": o, "byline_rule": kb, **hit} for o in keys if len(html) == 20_001]
        return work

    got = X._scan(pages, "html", F.array(F.lit("nyt")), X.HIT_TYPE, make)
    n, most = got.select("stories_id", F.explode("hits.byline_rule").alias("kb")).agg(F.countDistinct("stories_id"), F.max("kb")).first()
    assert n == 2000 and most < 100_000  # the batch as it came, not its 160 MB of texts
