"""Explicit schemas: reads never rely on inference."""

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, MapType,
                               StringType, StructField, StructType, TimestampType)

MATRIX_INT = ArrayType(ArrayType(LongType()))
MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])
CHAT = ArrayType(MESSAGE)

# raw rows a prompt table is prepared from: either list or string matrices
RAW_MATRIX_ROWS = StructType([
    StructField("pair_id", LongType()),
    StructField("user_query", StringType()),
    StructField("matrix_A_list", MATRIX_INT),
    StructField("matrix_B_list", MATRIX_INT),
    StructField("A_matrix_str", StringType()),
    StructField("B_matrix_str", StringType()),
])

PROGRAM_CORPUS = StructType([
    StructField("program_id", LongType()),
    StructField("prompt", StringType()),
    StructField("completion", StringType()),
])

COMPLETIONS = StructType([
    StructField("prompt_id", LongType()),
    StructField("gen_idx", IntegerType()),
    StructField("completion", StringType()),
])

METRIC_LOG = StructType([
    StructField("run", StringType()),
    StructField("step", LongType()),
    StructField("ts", TimestampType()),
    StructField("logs", MapType(StringType(), DoubleType())),
])

DISCOVERY = StructType([
    StructField("batch_id", LongType()),
    StructField("prompt_id", LongType()),
    StructField("gen_idx", IntegerType()),
    StructField("n_mults", IntegerType()),
    StructField("script", StringType()),
    StructField("found_at", TimestampType()),
])
