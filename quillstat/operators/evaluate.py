"""Scoring extracted bylines against hand labels.

One plan: labels ⋈ extraction (on media_id, stories_id) → per-row verdicts →
one global aggregate. Text tests are literal (the source used the label as an
unescaped regex; here a label is matched as text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.text import strip_ws
from quillstat.operators.joins import small_side


def _norm(c: Column) -> Column:
    return F.lower(strip_ws(c))


def actual_byline(is_correct: Column, labelled: Column, corrected: Column) -> Column:
    """E-1: the labelled byline when marked correct (any case of 'y'), else the correction (none: empty)."""
    return F.when(F.lower(is_correct) == "y", labelled).otherwise(F.coalesce(corrected, F.lit("")))


def extra_text(extracted: Column, actual: Column) -> Column:
    """E-3: when the extracted text contains the actual byline: 'prefix;suffix' around its
    LAST occurrence (lower-cased); null when it does not contain it."""
    x, a = _norm(extracted), _norm(actual)
    hit = F.instr(F.reverse(x), F.reverse(a))
    pos = F.length(x) - hit - F.length(a) + 2  # 1-based start of the last occurrence
    prefix = F.substring(x, F.lit(1), pos - 1)
    suffix = F.substr(x, pos + F.length(a))
    return F.when(hit > 0, F.concat(prefix, F.lit(";"), suffix))


def missing_text(extracted: Column, actual: Column) -> Column:
    """E-4: names of the actual byline (split on ';;') found in no part of the extracted
    byline, each followed by ';;;'."""
    parts = F.transform(F.split(extracted, ";;"), lambda r: _norm(r))
    miss = F.filter(F.split(actual, ";;"),
                    lambda s: ~F.exists(parts, lambda r: F.instr(r, _norm(s)) > 0))
    return F.array_join(F.transform(miss, lambda s: F.concat(s, F.lit(";;;"))), "")


def evaluate(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    """E-1…E-6: one evaluated row per labelled story found in the extraction.

    ``labels``: media_id, stories_id, url, byline_extracted_label, is_correct,
    byline_corrected, n_names. ``extracted``: media_id, stories_id, byline,
    female, male, unknown.
    """
    ex = extracted.select(F.col("media_id").alias("_mid"), "stories_id",
                          F.coalesce("byline", F.lit("")).alias("extracted"),
                          (F.col("female") + F.col("male") + F.col("unknown")).alias("n_found"))
    # hand labels are few: broadcast them when the bounded count says so; joining on the
    # story key keeps the extraction's existing partitioning either way
    lab = small_side(labels, max_rows=1_000_000)
    j = ex.join(lab, (ex["stories_id"] == lab["stories_id"]) & (F.col("_mid") == lab["media_id"]), "inner") \
        .drop(ex["stories_id"]).drop("_mid")
    actual = actual_byline(F.col("is_correct"), F.col("byline_extracted_label"), F.col("byline_corrected"))
    j = j.withColumn("actual", actual)
    correct = _norm(F.col("extracted")) == _norm(F.col("actual"))
    extra = extra_text(F.col("extracted"), F.col("actual"))
    return j.select(
        "media_id", "stories_id", "url",
        F.col("extracted").alias("extracted_byline"),
        F.col("actual").alias("actual_byline"),
        F.when(correct, "y").otherwise("n").alias("correct"),
        F.when(correct, F.lit("")).otherwise(F.coalesce(extra, F.lit(""))).alias("extra_text"),
        F.when(correct | extra.isNotNull(), F.lit(""))
         .otherwise(missing_text(F.col("extracted"), F.col("actual"))).alias("missing_text"),
        F.when(correct, F.col("n_names")).otherwise(F.col("n_found").cast("string")).alias("n_extracted"),
        F.col("n_names").alias("n_actual"),
    )


def accuracy(evaluated: DataFrame) -> DataFrame:
    """A-8: correct = 'y' rows + 'n' rows equal after lower/strip; incorrect = other 'n' rows
    with a non-empty actual byline; accuracy = correct / (correct + incorrect), null if 0/0."""
    same = _norm(F.col("extracted_byline")) == _norm(F.col("actual_byline"))
    is_n = F.col("correct") == "n"
    c = F.count_if(F.col("correct") == "y") + F.count_if(is_n & same)
    i = F.count_if(is_n & ~same & (F.length(F.lower(F.col("actual_byline"))) > 0))
    agg = evaluated.agg(c.alias("n_correct"), i.alias("n_incorrect"))
    return agg.select("n_correct", "n_incorrect",
                      F.round(F.try_divide(F.col("n_correct").cast("double"),
                                           (F.col("n_correct") + F.col("n_incorrect")).cast("double")), 6)
                      .alias("accuracy"))
