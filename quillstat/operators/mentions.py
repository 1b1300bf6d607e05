"""People mentioned in article text, and who mentions them.

M-1 (gazetteer match) replaces the remote people-entity service. A gazetteer of any size is
matched by an index of first tokens: an n-gram is built only where its first token
begins a name of n tokens, so a text's n-grams are not listed. Names are then told by a literal
lookup inside the projection, by a broadcast join, or by a salted shuffle join, by their bytes;
the rows are the same. Null and blank names match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.lookup import LITERAL_BYTES, bounded_values, few_rows, member
from quillstat.functions.names import full_names
from quillstat.functions.text import tokens
from quillstat.operators.gender import SALTS, with_gender
from quillstat.operators.reports import opinion_filter

#: Bytes of names up to which a larger gazetteer is broadcast to the join.
BROADCAST_BYTES = 64 << 20


def ngrams(tok: Column, n: int) -> Column:
    """All n-grams of a token array, joined by one space.

    Built from n shifted slices combined element-wise (``zip_with``): the token
    array is an argument, evaluated once, never re-evaluated inside a lambda."""
    length = F.greatest(F.size(tok) - n + 1, F.lit(0))
    acc = F.slice(tok, F.lit(1), length)
    for k in range(1, n):
        acc = F.zip_with(acc, F.slice(tok, F.lit(k + 1), length), lambda x, y: F.concat(x, F.lit(" "), y))
    return acc


def usable_names(people: DataFrame) -> DataFrame:
    """(name, n, first): the distinct names that a text can hold, their number of tokens and first token."""
    parts = F.split("name", " ")
    return (people.where(F.col("name").isNotNull() & F.forall(parts, lambda t: t != "")).select("name").distinct()
            .select("name", F.size(parts).alias("n"), F.element_at(parts, 1).alias("first")))


def started_grams(tok: Column, sizes: list[int], starts: list[str]) -> Column:
    """The n-grams (n in ``sizes``) of a token column that begin with a token that starts a name of n tokens;
    ``starts`` holds 'n token'. ``tok`` has to be a plain column: the lambdas refer to it."""
    per_size = []
    for n in sizes:
        begins = [s.split(" ", 1)[1] for s in starts if s.startswith(f"{n} ")]
        places = F.when(F.size(tok) >= n, F.sequence(F.lit(1), F.size(tok) - (n - 1))).otherwise(F.array().cast("array<int>"))
        at = F.filter(places, lambda i: member(F.element_at(tok, i), begins))  # noqa: B023
        per_size.append(F.transform(at, lambda i: F.array_join(F.slice(tok, i, F.lit(n)), " ")))  # noqa: B023
    return F.concat(*per_size)


def gazetteer_mentions(docs: DataFrame, people: DataFrame, key: str = "stories_id",
                       text_col: str = "full_text", max_inline: int = LITERAL_BYTES,
                       max_broadcast: int = BROADCAST_BYTES, max_starts: int = LITERAL_BYTES) -> DataFrame:
    """(key, name, count): how often each gazetteer name occurs in the text.

    The bytes of names up to ``max_inline`` are looked up inside the projection, up to ``max_broadcast``
    joined by broadcast, beyond that by salted names. The first tokens are a literal up to
    ``max_starts`` bytes, beyond that joined on salted tokens as well."""
    names = usable_names(people)
    starts = names.select("n", "first").distinct()
    listed = few_rows(names, "name", max_inline)
    begins = listed if listed is not None and max_starts > 0 else few_rows(starts, "first", max_starts)
    # materialise the tokens once (referenced by every n-gram size)
    docs = docs.select(key, tokens(F.col(text_col)).alias("_tok"))
    if begins is not None:
        index = sorted({f"{r.n} {r.first}" for r in begins})
        if not index:
            return docs.select(key, F.lit("").alias("name"), F.lit(0).cast("long").alias("count")).where(F.lit(False))
        grams = started_grams(F.col("_tok"), sorted({int(s.split(" ", 1)[0]) for s in index}), index)
    else:
        grams = None
    if grams is not None and listed is not None:
        told = sorted({r.name for r in listed})
        hits = docs.select(key, F.explode(F.filter(grams, lambda g: member(g, told))).alias("gram"))
        return hits.groupBy(key, F.col("gram").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    if grams is not None:
        found = docs.select(key, F.explode(grams).alias("gram"))
    else:
        # each token with the longest name's window behind it goes to the names' first tokens
        longest = names.agg(F.max("n")).first()[0] or 0
        windows = docs.select(key, F.posexplode(F.transform(F.col("_tok"), lambda t, i: F.slice(F.col("_tok"), i + 1, F.lit(max(longest, 1))))).alias("_at", "_win"))
        windows = windows.withColumns({"first": F.element_at("_win", 1), "_salt": F.pmod(F.xxhash64(key, "_at"), F.lit(SALTS)).cast("int")})
        found = windows.join(starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["first", "_salt"]).where(
            F.size("_win") >= F.col("n")).select(key, F.array_join(F.slice("_win", F.lit(1), F.col("n")), " ").alias("gram"))
    counted = found.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("count"))
    if bounded_values(names, "name", max_broadcast):
        known = counted.join(F.broadcast(names.select(F.col("name").alias("gram"))), "gram", "left_semi")
    else:
        salted = names.select(F.col("name").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        known = counted.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["gram", "_salt"], "left_semi")
    return known.select(key, F.col("gram").alias("name"), "count")


def mentioned_people(articles: DataFrame, mentions: DataFrame, lookup) -> DataFrame:
    """A-6 totals: per (outlet, mentioned name) over opinion articles: total count and the
    name's gender (``lookup``: see ``gender.name_lookup``). Totals come from the un-joined
    mentions, so a story with several byline people is not counted several times."""
    op = articles.where(opinion_filter("section")).select("stories_id", "media_name")
    m = mentions.join(op, "stories_id", "inner")
    agg = m.groupBy("media_name", "name").agg(F.sum("count").cast("long").alias("n_mentions"))
    return with_gender(agg, F.col("name"), lookup, fold=True)


def mention_bylines(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """A-6 breakdown / M-2 / J-9: per (outlet, mentioned name, byline person) the mention
    count, as flat rows (no per-group collection)."""
    op = (articles.where(opinion_filter("section"))
          .select("stories_id", "media_name", F.explode(full_names(F.col("byline"))).alias("mentioner")))
    m = mentions.join(op, "stories_id", "inner")
    return m.groupBy("media_name", "name", "mentioner").agg(F.sum("count").cast("long").alias("n"))
