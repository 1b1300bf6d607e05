"""Cases that earlier forms of the operators got wrong."""

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillstat.llm import common, langid, licenses, packing, pieces, queries, sketches, token_files

WARRANTY = licenses.TEMPLATES[2][1]
LONG = -(1 << 63)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_license_spans_that_verification_accepts_are_found(spark):
    w = WARRANTY.split()
    fourth = " ".join("zz" if i % 4 == 3 else x for i, x in enumerate(w))
    cut = " ".join(w[:11] + ["q"] * 5 + w[11:22] + ["r"] * 5 + w[22:])
    lgpl = next(t for label, t in licenses.TEMPLATES if label == "lgpl")
    got = {r["doc_id"]: r for r in licenses.scan(texts(
        spark, fourth, cut, "all rights reserved " * 3, "x " * 30 + lgpl, "Licensed under the Apache License, Version 2.0",
        "Licensed under the MIT License. " * 3, WARRANTY + " so " + WARRANTY, "under the license of the software " * 200)).collect()}
    spans = {i: [(s["label"], s["first"], s["last"]) for s in r["spans"]] for i, r in got.items()}
    assert [got[i]["labels"] for i in range(6)] == ["apache-2.0", "apache-2.0", "reserved", "gpl,lgpl", "apache-2.0", "mit"]
    assert 0.7 <= got[0]["score"] < 0.8 and got[1]["score"] == 1.0
    assert spans[2] == [("reserved", i, i + 2) for i in (0, 3, 6)] and spans[5] == [("mit", i, i + 4) for i in (0, 5, 10)]
    assert [s[0] for s in spans[3]] == ["lgpl"]  # the GPL's notice lies within the longer one; the base label stays
    assert len(spans[6]) == 2 and got[7]["labels"] == ""


def test_every_notice_is_found_with_a_tenth_of_its_words_changed(spark):
    rng = random.Random(1)
    rows = []
    for _, text in licenses.TEMPLATES:
        words = text.split()
        if len(words) >= licenses.SHORT_WORDS:
            for i in rng.sample(range(len(words)), len(words) // 10):
                words[i] = "changed"
        rows.append("some words before " + " ".join(words) + " and some behind")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(texts(spark, *rows)).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_base_columns_on_every_text(spark):
    rng = random.Random(2)
    bits = ["cc", "by", "CC BY", "cc-by", "General", "public", "LICENSE", "all", "rights", "reserved", ",", " ", "\n", "é", "x1", "日本", "\x00", "general public license"]
    rows = [None, "", *(" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300))]
    got = {r["doc_id"]: r for r in licenses.scan(texts(spark, *rows)).collect()}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for k in range(len(w)) for phrase, label in licenses.PHRASES if tuple(w[k:k + len(phrase)]) == phrase]
        want = (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want, t
        assert set(filter(None, want[4].split(","))) <= set(got[i]["labels"].split(",")) and (got[i]["score"] == 1.0 or not places)


def test_signs_that_are_no_letters_have_no_language(spark):
    rows = [(i, "die katze und der hund laufen" if i % 2 else "the cat and the dog run", "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, "½ ² ①", None), (101, "12 345", None), (102, "the ½ dog", None), (103, "x²", None)]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101)] == ["und", "und"] and got[100]["score"] == 0.0
    assert got[102]["lang_pred"] == "en" and got[103]["lang_pred"] in ("en", "de")


def test_more_languages_than_bits_of_one_mask(spark):
    rng = random.Random(3)
    letters = [chr(0x4E00 + 40 * i) for i in range(70)]
    rows = [(i * 100 + k, " ".join("".join(chr(ord(c) + rng.randrange(30)) for _ in range(6)) for _ in range(20)), f"l{i:02}")
            for i, c in enumerate(letters) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs).cells.shape[0] == 2
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs), ["doc_id", "text"]).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_filter_agrees_with_plain_counts(spark):
    """The filter has every n-gram of a language's share, and few others; corrected counts are near the plain ones."""
    rows = [(i, "die katze und der hund laufen schnell" if i % 2 else "the cat and the dog run fast", "de" if i % 2 else "en") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {lang: np.unique(langid.grams(text.split())[0]) for _, text, lang in rows[:2]}
    for i, lang in enumerate(model.languages):
        assert (model.masks(own[lang])[0] >> np.uint64(i) & np.uint64(1)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    rate = [(model.masks(other)[0] >> np.uint64(i) & np.uint64(1)).mean() for i in range(2)]
    assert max(rate) < 1e-3 and (model.rates() < 1e-6).all()


@pytest.mark.parametrize("ids", [[LONG, None, 5, None, LONG], [None], [LONG]])
def test_the_smallest_id_is_not_null(spark, ids):
    df = spark.createDataFrame([(i, f"text {k} of a few words") for k, i in enumerate(ids)], "doc_id long, text string")
    folder = token_files.write_token_files(df, queries.BYTE_BPE, 2)
    key = lambda i: (i is not None, i or 0)
    assert sorted((r["doc_id"] for r in token_files.read_documents(spark, folder).collect()), key=key) == sorted(ids, key=key)
    assert sorted((r["doc_id"] for r in sketches.fingerprint_edits(df).collect()), key=key) == sorted(ids, key=key)


def test_long_blocks_are_cut_where_no_piece_goes_across():
    words = pieces.vocabulary(queries.PIECE_BPE)
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefghé日本語中0123456789+/", k=3000)), "日本語" * 2000, "x" * 300, "Donaudampfschifffahrt" * 40 + "±±" + "the" * 90]
    whole = words.encode(long, np.arange(4, dtype=np.uint64))
    assert [b"".join(words.surface[i] for i in ids).decode() for ids in whole] == long
    inside = {p[i:i + 2] for p in words.weight for i in range(len(p) - 1)}
    for t in long:
        parts = words.cut(t)
        assert "".join(parts) == t and all(p[-1] + q[0] not in inside for p, q in zip(parts, parts[1:]))
    assert max(map(len, words.cut(long[1]))) == 1 and len(words.cut(long[2][:50])) == 1
    cut, words.cut = words.cut, lambda block: [block]  # the same draws without the cuts
    try:
        assert all((a == b).all() for a, b in zip(whole, words.encode(long, np.arange(4, dtype=np.uint64))))
    finally:
        words.cut = cut
    start = time.time()
    words.encode(["日本語" * 70_000], np.zeros(1, np.uint64))
    assert time.time() - start < 10


def test_the_order_of_ids_is_written_in_as_many_files_as_the_texts_come_in(spark):
    from pathlib import Path

    from quillstat.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:")) / "quillstat-llm"
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = set(folder.glob("*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [(7 * i % 400, f"a{i} b c d e f g{i % 9} " * (i % 5)) for i in range(400)] + [(3, "again"), (None, "no id")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
        keyed = docs.selectExpr("struct(doc_id is not null as known, coalesce(doc_id, 0) as value) as id", "xxhash64(text) as h", "text")
        got = {(tuple(r["id"]), r["h"]): (tuple(r["next_id"]), r["next_h"], r["n"]) for r in sketches.followers(keyed).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    order = sorted((tuple(r["id"]), r["h"], len(r["text"])) for r in keyed.collect())
    assert got == {(a[0], a[1]): (b[0], b[1], a[2]) for a, b in zip(order, order[1:] + order[:1])}
    made = set(folder.glob("*")) - before
    assert sum(len(list(d.glob("part-*"))) for d in made) <= 3


class Task:
    """Stands for a table: gives the function that ``mapInArrow`` would run in a Python task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak_mb(run, batch):
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_language_id_and_packing_tasks_hold_the_figures_of_few_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 12))) for _ in range(2_000)]
    rows = [" ".join(rng.choices(words, k=400)) for _ in range(1200)]  # 4 MB
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 600, "text": rows})
    assert peak_mb(langid.gram_counts(Task()), batch) < 15  # 20 when it took 4 MB at once
    coded = pa.RecordBatch.from_pydict({"doc_id": range(1200), "text": rows})
    cut = packing.cut(Task(), queries.BYTE_BPE, 2, 1024)
    list(cut(iter([coded])))  # the vocabulary is read once
    assert peak_mb(cut, coded) < 30  # 46 when it took 4 MB at once


def test_gram_counts_are_whole_however_often_they_are_added_up(monkeypatch):
    rows = [f"alpha{'bcdefg'[i % 6] * (i % 4)} words übung {'xyz'[i % 3] * 5}" * (i % 5) for i in range(300)]
    langs = [("en", "de", "fr")[i % 3] for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": rows})
    want = Counter()
    for lang, text in zip(langs, rows):
        for h in langid.grams(langid.letter_runs(text))[0].view(np.int64).tolist():
            want[lang, h] += 1
    for held, gather, at_once in ((1_000_000, 400_000, 1 << 20), (1_000_000, 10, 200), (40, 10, 200), (0, 0, 1)):
        monkeypatch.setattr(langid, "HELD", held)
        monkeypatch.setattr(langid, "GATHER", gather)
        monkeypatch.setattr(langid, "FEW_BYTES_AT_ONCE", at_once)
        got, n = Counter(), 0
        for part in langid.gram_counts(Task())(iter([batch])):
            n += part.num_rows
            for r in part.to_pylist():
                got[r["lang"], r["h"]] += r["n"]
        assert got == want and (n > len(want)) == (held < 100)


def test_texts_come_in_as_few_bytes_as_asked_for(spark):
    docs = texts(spark, "a" * 60, None, "b" * 60, "", "c" * 500, "d").coalesce(1)
    got = common.map_text(docs, ["doc_id", "text"], "n long, at_once long", lambda: lambda ts: {
        "n": [len(t or "") for t in ts], "at_once": [sum(len(t or "") for t in ts)] * len(ts)}, most=100)
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[:2] for r in rows] == [(0, 60), (1, 0), (2, 60), (3, 0), (4, 500), (5, 1)]
    assert all(at_once <= 100 or at_once == n for _, n, at_once in rows)
