"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

A rule decides where one fits. Urls that a rule decides are also the labelled urls: a
bounded sample of them trains Spark ML's gradient-boosted trees, which decide all others.
Features are lexical only (lengths, depth, digit ratio, character entropy, parameter and
sign counts) plus statistics of the host's suffixes: how often urls with the same last
label, and the same last two labels, are blocked among all labelled ones. All of it is
DataFrame work in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import quoted, written

#: (host, path, verdict), as given
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bound of the rows that train the trees (distinct labelled urls, chosen by hash); the suffixes count all labelled urls.
TRAIN_URLS = 20_000
#: Suffixes that are broadcast at most; the rarer ones of a larger table are joined by a shuffle.
BROADCAST_SUFFIXES = 40_000
#: A suffix's urls are spread over this many join keys.
SALTS = 8
TREES, DEPTH, SEED = 12, 4, 42
#: Weight of the overall block rate in a suffix's rate.
PRIOR = 10.0
FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "entropy",
            "parameters", "hyphens", "signs", "longest_label", "has_fragment", "last_rate", "last_count", "two_rate", "two_count"]
RESULT = ("host", "path", "rule", "verdict", "score")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit(f".{rule[0]}"))) & F.startswith(path, F.lit(rule[1]))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        rule = F.when(fits(host, path, r), F.lit(r[0] + r[1])).otherwise(rule)
        verdict = F.when(fits(host, path, r), F.lit(r[2])).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in nats."""
    n = F.length(text).cast("double")
    count = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double")
    spread = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                         lambda acc, c: acc + F.when(F.length(c) > 0, count(c) * F.log(count(c))).otherwise(0.0))
    return F.when(n > 0, F.log(n) - spread / n).otherwise(0.0)


def lexical(urls: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``urls`` plus the lexical features and both suffix names, each with the prefix ``f_``."""
    u = F.coalesce(F.col(url), F.lit(""))
    h, p = F.col(host), F.col(path)
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    times = lambda c, sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    made = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "query_length": F.length(query),
        "depth": F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))), "labels": times(h, "."),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)), "entropy": entropy(u),
        "parameters": F.when(F.length(query) > 0, times(query, "&") + 1).otherwise(0), "hyphens": times(h, "-"),
        "signs": F.length(F.regexp_replace(u, "[A-Za-z0-9]", "")), "has_fragment": F.contains(u, F.lit("#")).cast("int"),
        "longest_label": F.array_max(F.transform(F.split(h, r"\."), lambda x: F.length(x))),
    }
    return urls.select("*", *[c.cast("double").alias(f"f_{k}") for k, c in made.items()],
                       F.substring_index(h, ".", -1).alias("f_last"), F.substring_index(h, ".", -2).alias("f_two"))


@dataclass
class UrlModel:
    """``trees`` is None where the training urls do not show both verdicts; then all are allowed."""

    trees: GBTClassificationModel | None
    suffixes: tuple[DataFrame, DataFrame | None] | None
    rate: float

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with lexical features) plus f_score, the probability of a block."""
        if self.trees is None:
            return urls.withColumn("f_score", F.lit(0.0))
        out = with_suffixes(urls, self.suffixes, self.rate)
        out = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="f_vector").transform(out)
        return self.trees.transform(out).withColumn("f_score", vector_to_array("f_probability")[1])


def suffix_table(labelled: DataFrame) -> DataFrame:
    """(suffix, n, blocked) of both suffix lengths, from all of ``labelled`` (f_last, f_two, label)."""
    each = labelled.select(F.explode(F.array("f_last", "f_two")).alias("suffix"), "label")
    return each.groupBy("suffix").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("blocked"))


def by_frequency(suffixes: DataFrame, urls: int, most: int = BROADCAST_SUFFIXES) -> tuple[DataFrame, DataFrame | None]:
    """``suffixes`` of so many labelled ``urls``: (at most ``most`` to broadcast, the others or None).

    The counts add up to twice the urls, so no more than ``most`` suffixes reach ``2 * urls / most``."""
    if suffixes.limit(most + 1).count() <= most:
        return suffixes, None
    often = F.col("n") >= 2 * urls / most
    return suffixes.where(often), suffixes.where(~often)


def with_suffixes(urls: DataFrame, suffixes: tuple[DataFrame, DataFrame | None], rate: float) -> DataFrame:
    frequent, rare = suffixes
    for name in ("last", "two"):
        key = f"f_{name}"
        side = frequent.select(F.col("suffix").alias(key), F.col("n").alias("f_n"), F.col("blocked").alias("f_b"))
        urls = urls.join(F.broadcast(side), key, "left")  # bounded by by_frequency
        if rare is not None:
            # urls of frequent suffixes find nothing here and go anywhere; no salt of theirs is one of the table's
            spread = F.xxhash64(F.monotonically_increasing_id())
            salt = F.when(F.col("f_n").isNull(), F.pmod(spread, F.lit(SALTS))).otherwise(F.lit(SALTS) + F.pmod(spread, F.lit(1 << 20)))
            every = rare.select(F.col("suffix").alias(key), F.col("n").alias("f_n2"), F.col("blocked").alias("f_b2"),
                                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("f_salt"))
            urls = (urls.withColumn("f_salt", salt).join(every, [key, "f_salt"], "left").withColumn("f_n", F.coalesce("f_n", "f_n2"))
                    .withColumn("f_b", F.coalesce("f_b", "f_b2")).drop("f_salt", "f_n2", "f_b2"))
        n, b = F.coalesce("f_n", F.lit(0.0)), F.coalesce("f_b", F.lit(0.0))
        urls = (urls.withColumn(f"f_{name}_rate", (b + PRIOR * rate) / (n + PRIOR))
                .withColumn(f"f_{name}_count", F.log1p(n)).drop("f_n", "f_b"))
    return urls


def train(labelled: DataFrame, train_urls: int = TRAIN_URLS, most: int = BROADCAST_SUFFIXES) -> UrlModel:
    """Fit on ``labelled`` (url, host, path, verdict): distinct urls, at most ``train_urls`` of them by hash
    for the trees; the suffixes and the block rate are of all."""
    distinct = labelled.where("url is not null").groupBy("url").agg(*[F.min(c).alias(c) for c in ("host", "path", "verdict")])
    distinct = written(lexical(distinct, "url", "host", "path").select("url", "host", "path", "f_last", "f_two", (
        F.col("verdict") == "block").cast("double").alias("label")), "urls")
    sample = distinct.drop("f_last", "f_two").orderBy(F.xxhash64("url"), "url").limit(train_urls)
    sample = written(lexical(sample, "url", "host", "path"), "sample")
    if sample.select("label").distinct().count() < 2:
        return UrlModel(None, None, 0.0)
    n, blocked = distinct.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = blocked / n
    suffixes = by_frequency(written(suffix_table(distinct), "suffixes"), n, most)
    ready = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="f_vector").transform(with_suffixes(sample, suffixes, rate))
    trees = GBTClassifier(featuresCol="f_vector", labelCol="label", predictionCol="f_prediction", maxIter=TREES,
                          maxDepth=DEPTH, seed=SEED).fit(ready.select("f_vector", "label"))
    return UrlModel(trees.setProbabilityCol("f_probability").setRawPredictionCol("f_raw"), suffixes, rate)


def judge(pages: DataFrame, rules=RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of ``pages`` plus host, path, rule, verdict and score (the trees' probability of a
    block; null where a rule decided).

    A null url, or one without ``://``, has an empty host and path and is judged by the trees; ties
    and repeated rows are judged alike, urls of any length whole; an empty table gives no rows. Other columns are
    ignored whatever their names; a ``keep`` column that is called like one of the result gives way to it."""
    kept = [c for c in keep if c.lower() not in RESULT]
    parts = pages.select(F.struct(*quoted(kept)).alias("f_kept"), F.col(url).alias("f_url"))
    parts = parts.select("*", host_of(F.col("f_url")).alias("f_host"), path_of(F.col("f_url")).alias("f_path"))
    rule, verdict = rule_columns(F.col("f_host"), F.col("f_path"), rules)
    parts = parts.select("*", rule.alias("f_rule"), verdict.alias("f_verdict"))
    model = train(parts.where("f_verdict is not null").select(F.col("f_url").alias("url"), F.col("f_host").alias("host"),
                                                             F.col("f_path").alias("path"), F.col("f_verdict").alias("verdict")))
    scored = model.scored(lexical(parts, "f_url", "f_host", "f_path"))
    method = F.when(F.col("f_score") >= threshold, "block").otherwise("allow")
    return scored.select(*[F.col("f_kept")[c].alias(c) for c in kept], F.col("f_host").alias("host"), F.col("f_path").alias("path"),
                         F.col("f_rule").alias("rule"), F.coalesce("f_verdict", method).alias("verdict"),
                         F.when(F.col("f_rule").isNull(), F.col("f_score")).alias("score"))
