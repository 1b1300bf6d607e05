"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import (langid, licenses, negatives, packing, pieces, quality, simhash, sketches, spelling, token_counts, token_files,
                           urls, vectors)
from quillstat.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(documents(spark, sf_dir), BYTE_BPE, END_ID)
    return token_files.read_documents(spark, folder)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, END_ID, 1024)


def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(documents(spark, sf_dir))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), BYTE_BPE, 512)


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(documents(spark, sf_dir))


def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text."""
    back = pieces.decode(pieces.encode(documents(spark, sf_dir), PIECE_BPE), PIECE_BPE)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: the rows whose vec_id is divisible by 100; every seventh row's label is moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_id_files": token_id_files,
    "op2_best_fit_packing": best_fit_packing,
    "op3_quality_compression": compression_quality,
    "op4_sampled_pieces": sampled_pieces,
    "op5_url_verdicts": url_verdicts,
    "op6_simhash_components": simhash_components,
    "op7_token_counts": token_count,
    "op8_license_scan": license_scan,
    "op9_language_id": language,
    "op10_bottom_k_fingerprints": bottom_k_fingerprints,
    "op11_hard_negatives": hard_negatives,
    "op12_spelling_variants": spelling_variants,
    "op13_near_vectors": near_vectors,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(c.q AS DOUBLE[])) AS BIGINT) AS score
  FROM rows a JOIN rows c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
         n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 10""",
    "op13_near_vectors": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT u, v FROM links
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, COALESCE(c.n, 0) AS n_links, LEAST(e.vec_id, COALESCE(m.m, e.vec_id)) AS component_id,
       e.vec_id <= COALESCE(m.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN least m ON m.u = e.vec_id""",
}
