"""Very long texts, clashing names, empty tables, url features and sketch estimates against brute force."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstat.llm import langid, licenses, packing, pieces, quality, queries, simhash, sketches, token_counts, token_files, urls

TOK = Tokenizer.from_file(queries.BYTE_BPE)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_texts():
    rng = random.Random(11)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(5000)]
    spaced = " ".join(rng.choices(words, k=720_000)) + " all rights reserved"
    return [spaced, "".join(rng.choices(string.ascii_lowercase, k=(1 << 20) + 5000)), "short one", None]


LONG = long_texts()


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG[0]) > 4 << 20
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(LONG)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def ids():
    return [(TOK.encode(t, add_special_tokens=False).ids if t else []) + [2] for t in LONG]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_long_texts_are_tokenized_whole(spark, docs, ids):
    folder = token_files.write_token_files(docs, queries.BYTE_BPE, 2)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(spark, folder).collect())
    starts = np.append(0, np.cumsum([len(x) for x in ids])).tolist()
    assert got == [(i, starts[i], len(x), crc(x)) for i, x in enumerate(ids)]
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, queries.BYTE_BPE, 512).collect()}
    assert counted == {i: (len((t or "").encode()), len(x) - 1, len(x) > 513) for i, (t, x) in enumerate(zip(LONG, ids))}


def test_long_texts_are_packed_whole(docs, ids):
    rows = packing.pack_documents(docs, queries.BYTE_BPE, 2, 1024).collect()
    places = collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(ids):
        mine = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert [s for _, s, _ in mine] == np.append(0, np.cumsum([n for _, _, n in mine]))[:-1].tolist() and sum(n for _, _, n in mine) == len(x)
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) == -(-sum(map(len, ids)) // 1024)


def test_long_texts_are_judged_and_scanned_whole(docs):
    q = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(LONG):
        w = WORD.findall(t or "")
        assert (q[i]["n_words"], q[i]["word_chars"], q[i]["base_failed"]) == (len(w), sum(map(len, w)), len(w) < 50)
    scanned = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    n = len(LONG[0].split())
    assert (scanned[0]["n_words"], scanned[0]["n_base"], scanned[0]["first_word"], scanned[0]["base_labels"]) == (n, 1, n - 3, "reserved")
    assert (scanned[1]["n_words"], scanned[1]["n_base"], scanned[3]["n_words"]) == (1, 0, 0)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(docs).collect()}
    assert found[0] == found[1] == "en" and found[3] == "und"


def test_long_texts_are_fingerprinted_whole(docs):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_report(docs).collect()}
    for i, t in enumerate(LONG):
        w = WORD.findall(t or "")
        grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        bits = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        assert got[i] == f"{bits:016x}", i
    edits = {r["doc_id"]: r for r in sketches.fingerprint_edits(docs).collect()}
    for i, t in enumerate(LONG):
        t, after = t or "", LONG[(i + 1) % len(LONG)] or ""
        cut = len(t) // 4
        assert edits[i]["n_chars"] == len(t)
        assert edits[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()
    assert edits[0]["near_next"] < 0.01 and 0.5 < edits[0]["near_edited"] < 0.85  # three quarters of the shingles


def test_long_texts_are_sampled_whole(docs):
    back = pieces.decode(pieces.encode(docs, queries.PIECE_BPE), queries.PIECE_BPE)
    assert back.where(F.col("decoded") == F.coalesce("text", F.lit(""))).count() == len(LONG)


def test_names_that_clash_in_decode_and_judge(spark):
    rows = spark.createDataFrame([(1, "some words", "kept", "gone")], "doc_id long, text string, `a.b` string, Decoded string")
    made = pieces.encode(rows, queries.PIECE_BPE).join(rows.drop("text"), "doc_id")
    back = pieces.decode(made, queries.PIECE_BPE)
    assert back.columns == ["doc_id", "text", "ids", "a.b", "decoded"]
    assert (back.first()["decoded"], back.first()["a.b"]) == ("some words", "kept")
    assert pieces.decode(pieces.encode(rows.limit(0), queries.PIECE_BPE), queries.PIECE_BPE).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/fr/", "h", "dot", "s"), (2, None, None, None, "s")], "page_id long, url string, f_host string, `a.b` string, Score string")
    got = urls.judge(pages, keep=("page_id", "f_host", "a.b", "Score", "url"))
    assert got.columns == ["page_id", "f_host", "a.b", "url", "host", "path", "rule", "verdict", "score"]
    assert sorted(map(tuple, got.collect())) == [(1, "h", "dot", "http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow", None),
                                                 (2, None, None, None, "", "", None, "allow", 0.0)]


def test_names_that_clash_in_the_language_filter(spark):
    rows = [(i, text, lang, "a", 1.0, "x") for i in range(40) for text, lang in [("the brown fox jumps over the dog", "en"), ("der braune fuchs springt weit", "de")]]
    rows += [(99, None, "en", "a", 1.0, "x"), (98, "½ ²", None, "a", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Score double, `a.b` string")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:80])
    assert langid.keep_identified(docs.limit(0)).count() == 0


def brute_features(url):
    host = re.match(r"(?s).*?://([^/?#]*)", url)
    host = host[1].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) if host else ""
    path = re.match(r"(?s).*?://[^/?#]*([^?#]*)", url)
    path = path[1] if path else ""
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    query = query[1] if query else ""
    counts = collections.Counter(url)
    return {"url_length": len(url), "host_length": len(host), "path_length": len(path), "query_length": len(query),
            "depth": path.count("/"), "labels": host.count("."), "digit_ratio": sum(c in string.digits for c in url) / max(len(url), 1),
            "entropy": -sum(n / len(url) * math.log(n / len(url)) for n in counts.values()),
            "parameters": query.count("&") + 1 if query else 0, "hyphens": host.count("-"),
            "signs": sum(c not in string.ascii_letters + string.digits for c in url), "has_fragment": "#" in url,
            "longest_label": max(map(len, host.split(".")))}


def test_url_features_are_those_of_plain_python(spark):
    rng = random.Random(3)
    bits = ["http://", "https://", "A", "b.", "-", "9", "/", "?", "&", "=", "#", "é", "日", ".org", "$1", "\\", "\n", "%20", "x" * 40]
    cases = ["", "no host", "http://", "://a-b.c/d/e?x=1&y=2#f"] + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i long, url string")
    df = df.select("*", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    got = {r["i"]: r for r in urls.lexical(df, "url", "host", "path").collect()}
    for i, u in enumerate(cases):
        for name, value in brute_features(u).items():
            assert got[i][f"f_{name}"] == pytest.approx(float(value), abs=1e-9), (u, name)


def test_sketch_estimates(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(4000)]
    texts = [("", ""), ("", "a b"), ("a b", "a b"), ("a b c d e f", "a b c d e"), (" ".join(words[:100]), " ".join(words[:50])),
             (" ".join(words[:3000]), " ".join(words[1000:4000])), (" ".join(words[:1000]), " ".join(words))]
    df = spark.createDataFrame(texts, "a string, b string").select("a", "b", sketches.sketch(F.col("a")).alias("x"), sketches.sketch(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    rows = df.select("a", "b", sketches.distinct_shingles(x).alias("n"), sketches.containment(x, y).alias("c"),
                     sketches.merge(x, y).alias("m"), sketches.resemblance(sketches.merge(x, y), x).alias("r"), "x", "y").collect()

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for r in rows:
        a, b = shingles(r["a"]), shingles(r["b"])
        exact = len(a | b) < sketches.K
        assert r["n"] == pytest.approx(len(a), rel=1e-9 if exact else 0.3)
        assert r["c"] == pytest.approx(len(a & b) / len(a) if a else 1.0, abs=1e-9 if exact else 0.25)
        assert r["m"] == sorted(set(r["x"]) | set(r["y"]))[:sketches.K]  # the sketch of both parts together
        assert r["r"] == pytest.approx(len(a) / len(a | b) if a | b else 1.0, abs=1e-9 if exact else 0.2)
