"""Corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

``STAGES`` are applied in order; each takes what the one before kept.  ``run``
writes every stage as Parquet in the shared checkpoint folder and reads it
back, so that a lost executor costs one stage at most.

Contracts of the stages: null texts count as empty; null and repeated ids are
rows like any others (rows are kept or dropped one by one, never by a join on
``doc_id`` alone); an empty table passes through; columns beside those of
``documents`` are handed on until the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.spread import ensure_checkpoint_dir
from rollcall.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from rollcall.llm.common import table

SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier, fitted on ``labels``, holds to be bad."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), held_out=None)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the smallest ``doc_id`` stays."""
    return exact_dedup.drop_copies(docs, keep="min")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest ``doc_id`` stays."""
    return ngram_join.drop_near_copies(docs, n=SHINGLE_WORDS, percent=NEAR_PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that an earlier document has; texts that are wholly repeated become empty."""
    cut = substring_dedup.cut_repeats(docs, length=50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("substring_dedup", without_repeats), ("packing", packed)]

ORACLE_SQL = None  # the classifier's fit is not SQL; tests/llm compares every stage with a plain version of it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
