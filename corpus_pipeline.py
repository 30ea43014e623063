"""The corpus pipeline: documents to mixed, encoded training text.

Five stages, each on all that the stage before kept: reject low quality, drop
exact copies, keep one of each group of near copies, mix the sources to their weights,
encode.  A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet beside the session's checkpoints (storage that all
executors share) and reads it again as the next stage's documents; when the next result is
written, the one before is deleted.

Every stage takes documents with nulls in any column, empty and very long
texts, repeated rows, no rows, and extra columns: the stages in between
return exactly the columns of ``documents``; see the operators for the results defined.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm import exact_dedup, quality_classifier, sentencepiece_codec, simhash_neardup, source_mix
from quadrant.llm.common import id_remainder, table
from quadrant.session import checkpoint_dir, delete_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = 0.3  # quality score


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labelled
    documents outside the held-out fifth."""
    docs = _documents(docs)
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"), id_remainder("id", 5) != 0)
    return quality_classifier.with_scores(docs, model).filter(F.col("score") >= REJECT_BELOW).drop("score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.deduplicate(_documents(docs), survivor="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash_neardup.deduplicate(_documents(docs), shingle=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their weights: a row for each document and pass that takes words of it."""
    return source_mix.mixed_documents(_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (begin and end included), and the text decoded from them."""
    return sentencepiece_codec.encode(_documents(docs), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near),
          ("mixing sources", mix), ("SentencePiece encoding", encode)]

# Compression, fingerprints, pseudorandom mixing and merge rounds have no SQL: the pipeline is
# tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents table."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
