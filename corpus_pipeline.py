"""A training-data pipeline over ``documents``: quality rules, language ID, near-duplicates, packing.

Each stage works on all that the one before it kept; what a stage returns is written as Parquet in
the shared folder and read back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstat.llm import langid, packing, quality, simhash
from quillstat.llm.common import documents, written
from quillstat.llm.queries import BYTE_BPE, END_ID
from quillstat.session import prepare_session

SEQUENCE_TOKENS = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base figures and the compression bands."""
    prepare_session(spark)
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (learned from the other fold's rows of this stage)."""
    prepare_session(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of linked fingerprints."""
    prepare_session(spark)
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their sequences."""
    prepare_session(spark)
    return packing.pack_documents(docs, BYTE_BPE, END_ID, SEQUENCE_TOKENS)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates),
          ("best_fit_packing", best_fit_packing)]

#: None: compression, n-gram filters and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
