"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 20  # resolution of a hash sample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns, under the operator's own names; whatever else
    the caller's table carries (also under clashing names) is left behind."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only.  A text without multi-byte characters goes through
    ``lower`` (one pass over its bytes); others through ``translate``."""
    c = F.col(text) if isinstance(text, str) else text
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
             .otherwise(F.translate(c, upper, upper.lower())))


def keep_below(key: Column, share: float) -> Column:
    """True for about ``share`` of all keys, chosen by a hash of the key."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)) < math.ceil(min(1.0, share) * BUCKETS)
