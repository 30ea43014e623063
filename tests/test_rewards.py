"""Users' rewards, observed metrics, rollups and sketches, completions of any shape."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from quadrant.functions import text as tx
from quadrant.operators import evaluate as ev
from quadrant.operators import rewards
from quadrant.operators import score as sc


def functions():
    """Users' functions; made here so that they travel to the workers by value."""
    def words(completions, **_):
        return [len(c.split()) for c in completions]

    def inverse(completions, n, **_):
        return [1 / k for k in n]

    def short(completions, **_):
        return [1.0] * (len(completions) - 1)

    def nothing(completions, **_):
        return [None for _ in completions]

    return {"words": words, "inverse": inverse, "short": short, "nothing": nothing}


def test_user_rewards_in_one_pass(spark):
    rows = [(k, "a b" * (k % 3 + 1), k % 4, f"x{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, n int, other string").repartition(3)
    got = rewards.with_user_rewards(df, functions(), "text", ["n"])
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # one MapInArrow, no UDF per function
    for r in got.collect():
        assert r.reward_words == len(r.text.split()) and r.error_words is None and r.other == f"x{r.id}"
        assert r.reward_inverse == (1 / r.n if r.n else None)
        assert (r.error_inverse == "ZeroDivisionError: division by zero") == (r.n == 0)
        assert r.reward_short is None and r.error_short == "ValueError: 0 rewards for 1 completions"
        assert r.reward_nothing is None and r.error_nothing is None
    words, inverse = functions()["words"], functions()["inverse"]
    penal = rewards.with_user_rewards(df, {"inverse": inverse}, "text", ["n"], on_error=-1.0)
    assert {r.reward_inverse for r in penal.where("n = 0").collect()} == {-1.0}
    assert rewards.with_user_rewards(df.limit(0), {"words": words}, "text").count() == 0


def test_failures_are_those_of_their_rows():
    words, inverse = functions()["words"], functions()["inverse"]
    got = rewards.called_safely(inverse, ["a", "b", "c"], {"n": [1, 0, 2]})
    assert got == ([1.0, None, 0.5], [None, "ZeroDivisionError: division by zero", None])
    assert rewards.called_safely(words, [], {}) == ([], [])


SCORED = "prompt_id long, gen_idx int, status string, reward double, correct boolean, n_mults int"
ROWS = [(k, 0, sc.STATUSES[k % 4], float(k % 7) - 3, k % 4 == 0, 9 - k % 3) for k in range(60)]


def test_observed_metrics_equal_the_queries(spark, tmp):
    df = spark.createDataFrame(ROWS, SCORED).repartition(4)
    m = sc.write_observed(df, os.path.join(tmp, "rows"))
    back = spark.read.parquet(os.path.join(tmp, "rows"))
    assert back.count() == 60
    assert {s: m[s] for s in sc.STATUSES if m[s]} == {r.status: r.n for r in sc.status_tally(back).collect()}
    mean, best = back.agg(F.avg("reward"), F.min(F.when(F.col("correct"), F.col("n_mults")))).first()
    assert m["mean_reward"] == pytest.approx(mean) and m["best_n_mults"] == best == sc.best_script(back.withColumn("script", F.lit("s"))).first().best_n_mults
    empty = sc.write_observed(df.limit(0), os.path.join(tmp, "none"))
    assert empty["n"] == 0 and empty["mean_reward"] is None


def test_a_stream_reports_the_metrics(spark, tmp):
    source = os.path.join(tmp, "in")
    spark.createDataFrame(ROWS, SCORED).coalesce(1).write.parquet(source)
    stream = sc.observed(spark.readStream.schema(SCORED).parquet(source))
    query = stream.writeStream.format("noop").option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    seen = [p.observedMetrics["scores"] for p in query.recentProgress if p.observedMetrics]
    assert sum(s["n"] for s in seen) == 60 and sum(s["correct"] for s in seen) == 15


def test_rollup_and_null_keys(spark):
    rows = [("a", "S", True, True, 3), ("a", "F", False, False, None), (None, "S", True, False, 8), ("b", None, False, False, 1)]
    df = spark.createDataFrame(rows, "model string, status string, correct boolean, efficient boolean, multiplications int")
    got = {(r.model, r.status, r.level): (r.n, r.correct, r.multiplications) for r in ev.evaluation_rollup(df, "model", "status").collect()}
    assert got[None, None, 3] == (4, 2, 12) and got[None, None, 1] == (1, 1, 8) and got["a", None, 1] == (2, 1, 3)
    assert got["b", None, 0] == (1, 0, 1) and got["b", None, 1] == (1, 0, 1) and len(got) == 8


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("k"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("v"))
    kept = ev.distinct_sketches(df, "v", "k")
    assert kept.count() == 5
    whole = ev.reuse_ratio(kept.withColumn("all", F.lit(1)), "all").first()
    bound = 3 * 1.04 / math.sqrt(1 << ev.SKETCH_LOG2)
    assert whole.n == 60_000 and abs(whole.n_distinct / 20_000 - 1) < bound and whole.reuse == pytest.approx(3, rel=bound * 1.1)
    assert all(abs(r.n_distinct / 4_000 - 1) < bound for r in ev.reuse_ratio(kept, "k").collect())


MESSAGE = {"role": "assistant", "content": "hi \"there\"\n"}
SHAPES = [("text", "text"), (MESSAGE, MESSAGE["content"]), ([MESSAGE], MESSAGE["content"]), (["one"], "one"), ("", ""),
          (["one", "two"], '["one","two"]'), ([], "[]"), ({"role": "x"}, '{"role":"x"}'), ({"content": "no role"}, '{"content":"no role"}'),
          ([MESSAGE, MESSAGE], None), (5, "5"), ([7], "7"), (True, "true"), (None, None), ([None], None), ([["deep"]], '["deep"]'),
          ({"role": "x", "content": 3}, '{"content":3,"role":"x"}')]


def test_shapes_are_decided_per_row(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in enumerate(SHAPES)] + [(100, "{broken"), (101, None), (102, "plain text")]
    df = spark.createDataFrame(rows, "k int, raw string")
    got = {r.k: r.t for r in df.select("k", tx.normalize_json("raw").alias("t")).collect()}
    for k, (v, want) in enumerate(SHAPES):
        if want is None and v is not None and v != [None]:
            want = json.dumps([dict(sorted(m.items())) for m in v], separators=(",", ":"))
        assert got[k] == want, v
    assert (got[100], got[101], got[102]) == ("{broken", None, "plain text")
    column = df.select("k", F.try_parse_json("raw").alias("v"))
    again = {r.k: r.completion for r in tx.normalize_completion(column, "v").collect()}
    assert all(again[k] == got[k] for k in range(len(SHAPES)))
