"""Completions made in Arrow batches equal the SQL stages they stand for."""

from pyspark.sql import functions as F

from quadrant.sources import derive as dv
from quadrant.sources import replies
from quadrant.sources import tables as tb
from quadrant.sources.sqlgen import SPARK, apply_stages


def test_replies_equal_the_sql_stages(spark):
    keys = (spark.range(6000).select((F.col("id") * 7919 - 9000).alias("_key"), (F.col("id") * 31 - 40000).alias("part"))
            .union(spark.createDataFrame([(None, 5), (None, None), (2 ** 62, 7), (-2 ** 62, 8)], "_key bigint, part bigint"))
            .union(spark.range(200).select("id", F.lit(None).cast("bigint"))))
    both = apply_stages(keys, dv.completion_stages(SPARK, "_key", "part")).select(
        "_key", "part", F.col("completion").alias("want"), replies.reply(F.col("_key"), F.col("part")).alias("got")).collect()
    assert len(both) == 6204 and [r for r in both if r.want != r.got] == []
    assert any(r.got is None for r in both[6004:]) and any(r.got for r in both[6004:])


def test_completions_run_no_lambdas(spark, tmp):
    """Programs were made by interpreted lambdas, at 88 us of a core a row."""
    spark.createDataFrame([(k, k % 3, k * 5) for k in range(9)], "l_orderkey bigint, l_linenumber int, l_partkey bigint") \
         .write.parquet(f"{tmp}/lineitem.parquet")
    df = tb.completions(spark, tmp)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.where("completion IS NOT NULL").count() == 9
