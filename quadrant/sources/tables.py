"""Driver tables and the DataFrames derived from them (S7-S9 guards included)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions import matrix as mx
from quadrant.sources import derive as dv
from quadrant.sources.replies import reply
from quadrant.sources.sqlgen import SPARK, apply_stages

# ---- fixed values: prompt text -------------------------------------------------
# Default user message when a raw row has no query text.
DEFAULT_USER_PROMPT = ("Generate the DSL script to calculate C = A * B for the given 2x2 matrices, "
                       "using 7 or fewer multiplications.First think about answer then respond in "
                       "<DSL></DSL> tags.")
# System message of the training prompts.
SYSTEM_MESSAGE = """You are an AI assistant specialized in generating Domain Specific Language (DSL) scripts for 2x2 matrix multiplication. You can provide explanations, but must wrap your DSL code in <DSL></DSL> tags.
  EXAMPLE DSL OUTPUT FORMAT: For matrices A=[[1,2],[3,4]] and B=[[5,6],[7,8]], a valid response would be:  
<DSL>
""" + dv.PROMPT_EXAMPLE7 + """
</DSL>

This uses 7 multiplications, but can be optimized using techniques like Strassen's algorithm.  YOUR TASK: Generate a DSL script that performs 2x2 matrix multiplication using 7 or fewer multiplications. You may provide explanations outside the DSL tags, but the actual code must be within <DSL></DSL> tags. 
DSL SYNTAX RULES: - M variables: Store multiplication results (e.g., M1 = A[0,0] * B[0,0]) - S variables:
 Store addition/subtraction results (e.g., S1 = M1 + M2) - Matrix elements: A[row,col] and B[row,col] where row,col ∈ {0,1} - Final output: C[row,col] = result - Operations: + (addition), * (multiplication), - (subtraction) - Variable assignment: VAR = expression 
  REQUIREMENTS: - Use ≤7 multiplications total within the <DSL></DSL> tags - Compute all four elements: C[0,0], C[0,1], C[1,0], C[1,1] - Wrap DSL code in <DSL></DSL> tags - You may add explanations outside the tags  If you cannot determine a valid sequence, output: Error: Cannot determine full sequence."""
# Prompt of every program-corpus row.
CORPUS_PROMPT = ("Generate a DSL script that multiplies two 2×2 matrices. Return only the code "
                 "inside <DSL> ... </DSL> tags.")
# ---------------------------------------------------------------------------------


class EmptySource(RuntimeError):
    """A source exists but holds no rows."""


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting columns up front keeps the scan's ReadSchema
    narrow (column pruning reaches the reader)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def deal(keys: DataFrame) -> DataFrame:
    """Deal narrow key rows out to all tasks.  The texts below are derived from
    keys, which costs far more than their bytes suggest, and a key file may be one
    split.  Only keys move; joins on them shuffle anew where Spark asks for it, so
    its skew handling stays in force."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when a source is empty (one-row probe, not a count)."""
    if df.isEmpty():
        raise EmptySource(f"{what} has no rows")
    return df


def enough_rows(df: DataFrame, batch: int, accum: int, world: int = 1) -> bool:
    """At least two optimisation steps of data (limit-bounded probe)."""
    need = batch * accum * 2 * world
    return df.limit(need).count() >= need


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per order (G1 with G2 edge rows, G4, G5, P6)."""
    o = deal(read_table(spark, sf_dir, "orders", ["o_orderkey"]))
    a, b = dv.prompt_matrices(SPARK, "o_orderkey")
    df = o.select(F.col("o_orderkey").alias("prompt_id"), F.expr(a).alias("A"), F.expr(b).alias("B"))
    return (df.withColumn("C", mx.product("A", "B"))
              .withColumn("user_query", F.concat(F.lit("Given matrices A = "), mx.compact_repr("A"),
                                                 F.lit(" and B = "), mx.compact_repr("B"),
                                                 F.lit(", what is the resulting matrix C = A * B?")))
              .withColumn("A_matrix_str", mx.py_repr("A"))
              .withColumn("B_matrix_str", mx.py_repr("B"))
              .withColumn("expected_C_str", mx.py_repr("C")))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completion per lineitem row: prompt = order, generation = line."""
    li = deal(read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]))
    return li.select(F.col("l_orderkey").alias("prompt_id"), (F.col("l_linenumber") - 1).cast("int").alias("gen_idx"),
                     reply(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey")).alias("completion"))


def programs(spark: SparkSession, sf_dir: str, max_mul: int = 12) -> DataFrame:
    """Random-program corpus, one per order key."""
    o = deal(read_table(spark, sf_dir, "orders", ["o_orderkey"])).select(
        F.col("o_orderkey").alias("program_id"))
    df = apply_stages(o, dv.program_stages(SPARK, "program_id", max_mul=max_mul))
    return df.select("program_id", F.lit(CORPUS_PROMPT).alias("prompt"),
                     F.expr(dv.wrap_dsl(SPARK, dv.program_text(SPARK))).alias("completion"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evaluation replies: test = order, model = part brand."""
    li = deal(read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    a, b = dv.test_matrices(SPARK, "l_orderkey")
    df = li.join(part, li.l_partkey == part.p_partkey, "left")  # a reply of no known model stays
    return df.select(F.col("l_orderkey").alias("test_id"), F.col("l_linenumber").cast("int").alias("attempt"),
                     F.col("p_brand").alias("model"), F.expr(a).alias("A"), F.expr(b).alias("B"),
                     F.expr(dv.response_text(SPARK, "l_orderkey * 8 + l_linenumber")).alias("response"))
