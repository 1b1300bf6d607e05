"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined in Spark to the template positions with
the same hash (the template table is a constant: the notices below, broadcast). A match of
text position p and template position t votes for the diagonal p - t. Votes are added up by
text, template and diagonal; neighbouring diagonals (words inserted or left out shift the
diagonal, by up to a quarter of the template) are merged; what has enough votes is a candidate, in
which every span is verified on the words of the text: enough of the template's words must be found
there in order. A span that lies within a longer one of another notice is not told.
"""

from __future__ import annotations

import bisect
import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstat.llm.common import slices, text_hash, written

K = 3
#: Diagonals this far apart, or a quarter of the template's words, belong together.
GAP = 3
#: Share of a template's words that a span must have in order.
MIN_WORDS = 0.7
#: Share of a template's k-grams a candidate needs. With 30 % of the words changed one by one, a tenth of the 3-grams
#: stays at least; in a notice of few words a changed one may be the license's name, so it needs more.
MIN_VOTES, SHORT_WORDS, MIN_VOTES_SHORT = 0.1, 12, 0.4
#: Candidate spans up to this number are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_SPANS = 100_000

#: Phrases (as words) whose places are counted exactly, and their labels.
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))

#: Notices of public licenses and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
            "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)

#: ASCII letters lower-cased, digits and bytes of other scripts kept, all else a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def rolling(words: list[bytes], k: int = K) -> np.ndarray:
    """64-bit hashes of all windows of k words."""
    import xxhash

    if len(words) < k:
        return np.empty(0, np.int64)
    known: dict[bytes, int] = {}
    each = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[j:len(words) - k + 1 + j]
    return out.view(np.int64)


def template_positions(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(gram, template, place): every k-gram position of every template; a constant table."""
    rows = [(int(g), t, i) for t, (_, text) in enumerate(templates) for i, g in enumerate(rolling(words_of(text)))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def gram_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, gram): one row for each window of k words of each text."""

    def run(batches):
        for part in slices(batches):
            grams = [rolling(words_of(t)) for t in part.column(2).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), lists], names=["doc_id", "h", "grams"])

    lists = docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, grams array<long>")
    return lists.select("doc_id", "h", F.posexplode("grams").alias("pos", "gram"))


def candidates(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, h, template, low, high): merged diagonals with enough votes."""
    sizes = [len(words_of(text)) for _, text in templates]
    needed = [max(1, int(np.ceil((MIN_VOTES if n >= SHORT_WORDS else MIN_VOTES_SHORT) * (n - K + 1)))) for n in sizes]
    of_template = lambda values: F.element_at(F.array(*[F.lit(n) for n in values]), F.col("template") + 1)
    gap = of_template([gap_of(n) for n in sizes])
    matched = gram_positions(docs).join(F.broadcast(template_positions(docs.sparkSession, templates)), "gram")
    # repeated rows vote once: min and max of the votes' places do not count, distinct ones do
    votes = matched.groupBy("doc_id", "h", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count_distinct("pos").alias("votes"))
    of_one = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    starts = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of_one), gap + 1) > gap).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(of_one.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "h", "template", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"),
                                                                F.max("diagonal").alias("high"))
    return merged.where(F.col("votes") >= of_template(needed)).select("doc_id", "h", "template", "low", "high")


def gap_of(n: int) -> int:
    """How far apart the diagonals of a template of n words may be."""
    return max(GAP, n // 4)


def verified(words: list[bytes], template: list[bytes], low: int, high: int) -> list[tuple[int, int, float]]:
    """(first word, last word, share of the template's words found in order) of every span of a candidate, none
    overlapping another.

    Diagonals that go on for longer than the template (its phrases repeat, or the notice does) are verified
    in stretches of its length, and again behind each span that is found."""
    n = len(template)
    spans = {_span(words, template, at, min(high - at, n)) for at in range(low, high + 1, n)}
    at = low
    while at <= high + GAP:
        span = _span(words, template, at, max(0, min(high - at, n)))
        spans.add(span)
        at = max(at + 1, span[1] + 1 + GAP) if span else at + n
    return apart(sorted((s for s in spans if s), key=lambda s: (-s[2], s)))


def apart(spans: list[tuple]) -> list[tuple]:
    """The spans (first, last, ...) that overlap none before them, by their place."""
    taken: list[tuple] = []
    ends: list[int] = []  # first and last words of the taken ones, in order
    for s in spans:
        i = bisect.bisect_left(ends, s[0])
        if i % 2 == 0 and (i == len(ends) or ends[i] > s[1]):
            ends[i:i] = [s[0], s[1] + 0.5]
            taken.append(s)
    return sorted(taken)


def _span(words: list[bytes], template: list[bytes], low: int, reach: int) -> tuple[int, int, float] | None:
    start = max(0, low - GAP)
    window = words[start:low + len(template) + GAP + reach]
    blocks = [b for b in difflib.SequenceMatcher(None, template, window, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    share = sum(b.size for b in blocks) / len(template)
    if share < MIN_WORDS:
        return None
    return start + blocks[0].b, start + blocks[-1].b + blocks[-1].size - 1, share


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    out = []
    for phrase, label in PHRASES:
        want = [p.encode() for p in phrase]
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at:at + len(want)] == want:
                out.append((at, label))
    return out


def told(words: list[bytes], candidates, prepared: list[tuple[str, list[bytes]]]) -> list[dict]:
    """The verified spans of a text's candidates: of one notice none overlap, and none lies within a span of
    another notice that holds more of its words."""
    per: dict[int, list[tuple]] = {}
    for c in candidates:
        per.setdefault(c["template"], []).extend(verified(words, prepared[c["template"]][1], c["low"], c["high"]))
    per = {t: apart(sorted(set(spans), key=lambda s: (-s[2], s))) for t, spans in per.items()}
    starts = {t: [s[0] for s in spans] for t, spans in per.items()}

    def within(span: tuple, template: int) -> bool:
        """Whether a span of another notice holds this one and has more words."""
        for t, spans in per.items():
            i = bisect.bisect_right(starts[t], span[0]) - 1  # of a notice's spans only this one can
            if t != template and i >= 0 and spans[i][1] >= span[1] and \
                    spans[i][2] * len(prepared[t][1]) > span[2] * len(prepared[template][1]):
                return True
        return False

    return [{"label": prepared[t][0], "first": a, "last": b, "share": share}
            for a, b, share, t in sorted((*s, t) for t, spans in per.items() for s in spans if not within(s, t))]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, first word, last word, share of the template).

    A null text is empty, one of any length is scanned whole; repeated rows are scanned each; ids are longs; other columns are ignored; an empty table gives no
    rows. Of overlapping spans of one notice the one with the larger share is told (ties: the first).
    ``score`` is 1 with a phrase's place, else the best verified share, else 0."""
    rows = docs.select("doc_id", text_hash().alias("h"), "text")
    found = written(candidates(rows, templates), "license-spans")
    n = found.count()
    by_text = found.groupBy(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h")).agg(
        F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("spans"))
    side = F.broadcast(by_text) if n <= BROADCAST_SPANS else by_text
    joined = rows.join(side, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left").select("doc_id", "text", "spans")
    prepared = [(label, words_of(text)) for label, text in templates]
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for part in slices(batches):
            made = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = words_of(text)
                places = base_places(words)
                ok = told(words, spans or (), prepared)
                base = {label for _, label in places}
                score = 1.0 if places else max((s["share"] for s in ok), default=0.0)
                made.append((len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in ok})), score, ok))
            n_words, n_base, first, last, base, labels, score, ok = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(last, pa.int64()), pa.array(base), pa.array(labels), pa.array(score, pa.float64()), pa.array(ok, span)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                  "score double, spans array<struct<label:string,first:long,last:long,share:double>>")
