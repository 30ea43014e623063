"""Exact duplicates (native DataFrame operations only).

Texts are equal when they are identical after lower-casing A-Z.  Rows are
grouped by a 128-bit hash of the normalised text *and* the text itself: the
group-by compares the bytes inside every hash group, so two texts that share a
hash stay apart.  A group-by pre-aggregates before its shuffle, so a text that a
third of all rows carry leaves each task as one row; what is shuffled is every
different text once per task.  The groups, reduced to digests, are joined
back to the rows' digests; that join carries no text, and its hot keys are
split by Spark's skew-join handling (nothing above the join needs the rows of
a key together).

Defined results: a null text counts as empty; a null id never wins against a
non-null one (a group of null ids only has a null ``keep_id``, and keeps one of
its rows in ``deduplicate``); rows repeated with the same id and text all name
that id, count in ``group_size``, and are all ``kept`` in the report, where
rows cannot be told apart; ``deduplicate`` returns one of them.  An empty
table gives an empty result.  Extra columns do not matter to ``duplicate_groups``
and are carried along by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.llm.common import ascii_lower, narrow


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _normalised(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text (normalised), hash128, sha256 of every row."""
    return (narrow(documents, id=doc_id, text=text)
            .select("id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
            .select("id", "text", content_hash(F.col("text")).alias("hash128"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


def groups(rows: DataFrame, survivor: str = "max") -> DataFrame:
    """One row per different text: its digests, surviving id and size."""
    pick = {"max": F.max, "min": F.min}[survivor]
    return (rows.groupBy("hash128", "text")
                .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                .select("hash128", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "keep_id",
                        "group_size"))


def duplicate_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     survivor: str = "max") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``survivor`` says which id of a group stays: its largest or smallest."""
    rows = _normalised(documents, doc_id, text)
    found = groups(rows, survivor).select(F.col("hash128").alias("h"), F.col("sha256").alias("s"), "keep_id",
                                          "group_size")
    slim = rows.select("id", "hash128", "sha256")
    joined = slim.join(found, (F.col("hash128") == F.col("h")) & (F.col("sha256") == F.col("s")))
    return joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                         F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.col("sha256").alias("text_sha256"))


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                survivor: str = "max") -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    The surviving (text, id) pairs carry no text but its digests; the
    documents are semi-joined to them, so no column of the caller's can clash,
    and rows repeated under one id are reduced to one afterwards."""
    keys = [f"__dedup_{x}" for x in ("id", "h", "s")]
    norm = ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    tagged = (documents.withColumn(keys[0], F.col(f"`{doc_id}`"))
              .withColumn(keys[1], content_hash(norm))
              .withColumn(keys[2], F.sha2(norm.cast("binary"), 256)))
    stay = groups(_normalised(documents, doc_id, text), survivor)
    match = ((F.col(keys[1]) == F.col("hash128")) & (F.col(keys[2]) == F.col("sha256"))
             & F.col(keys[0]).eqNullSafe(F.col("keep_id")))
    kept = tagged.join(stay.select("hash128", "sha256", "keep_id"), match, "left_semi")
    return kept.dropDuplicates(keys).drop(*keys)
