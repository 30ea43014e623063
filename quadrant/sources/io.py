"""File sources and sinks (S1-S6, S9).  Reads use explicit schemas; JSON
reads keep malformed lines in a corrupt-record column instead of failing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quadrant import schemas

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON-lines scan with an explicit schema (PERMISSIVE: a bad line
    becomes a row with only ``_corrupt_record`` set)."""
    full = StructType(list(schema.fields) + [StructField(CORRUPT, StringType())])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.RAW_MATRIX_ROWS)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A locally stored dataset snapshot (parquet)."""
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 (not ASCII-escaped; equal after parsing)."""
    df.write.mode(mode).json(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append-only log table (e.g. discoveries)."""
    df.write.mode("append").parquet(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested evaluation results as parquet."""
    df.write.mode(mode).parquet(path)


def peek(df: DataFrame, order_by: str) -> tuple[list[str], dict | None]:
    """Column names and the first row by a key (one-row probe)."""
    row = df.orderBy(order_by).limit(1).collect()
    return df.columns, (row[0].asDict(recursive=True) if row else None)


def good_rows(df: DataFrame) -> DataFrame:
    """Rows that parsed (drops the corrupt-record column).  Spark refuses a
    query over raw JSON whose only referenced column is the corrupt-record
    column (e.g. a bare ``count()`` after this filter): read a data column
    too, or persist the parsed table first."""
    if CORRUPT not in df.columns:
        return df
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def first_rows(df: DataFrame, order_by: str, n: int) -> DataFrame:
    """T-4: the first ``n`` rows by a key, for display (the limit is the
    feature here; it is a top-n, not a sample)."""
    return df.orderBy(order_by).limit(n)
