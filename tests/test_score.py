"""Rewards for the fixture completions (FIXTURES.md section 4) and
properties of the group statistics."""

import pytest
from pyspark.sql import functions as F

import golden as G
from quadrant.operators import score as sc
from quadrant.sources import tables as tb

PROMPT = ("[[1, 2], [3, 4]]", "[[5, 6], [7, 8]]", "[[19, 22], [43, 50]]")
S = G.STRASSEN
CASES = [  # (completion, v1, v2)
    (f"<DSL>\n{S}\n</DSL>", -6.9, -7.6),
    (S, -7.0, -7.7),
    ("Here it is\n" + S, -100.0, -100.0),
    (f"<dsl>\n{S}\n</dsl>", -6.9, -7.6),
    (f"<DSL>\n{S}\n</DSL><DSL>C[0,0] = 1</DSL>", -6.9, -7.6),
    ("<DSL></DSL>", -99.9, -100.0),
    ("<DSL>Error: Cannot determine full sequence.</DSL>", -99.9, -99.9),
    (f"<DSL>\n{S}<|im_end|>\n</DSL>", -6.9, -7.6),
    (f"<DSL>\n{G.BUILTIN7}\n</DSL>", -99.9, -107.6),
]


@pytest.fixture(scope="module")
def frames(spark):
    comps = spark.createDataFrame([(0, i, c) for i, (c, _, _) in enumerate(CASES)],
                                  "prompt_id bigint, gen_idx int, completion string")
    prompts = spark.createDataFrame([(0, *PROMPT)], "prompt_id bigint, A_matrix_str string, B_matrix_str string, "
                                                    "expected_C_str string")
    return comps, prompts


@pytest.mark.parametrize("version", [1, 2])
def test_fixture_rewards(frames, version):
    comps, prompts = frames
    got = {r.gen_idx: r.reward for r in sc.score(comps, prompts, version).select("gen_idx", "reward").collect()}
    for i, (_, v1, v2) in enumerate(CASES):
        assert got[i] == pytest.approx(v1 if version == 1 else v2, abs=1e-9), (i, version)


def test_unreadable_matrices(spark, frames):
    comps, _ = frames
    bad = spark.createDataFrame([(0, "nope", "[[5, 6], [7, 8]]", "[[19, 22], [43, 50]]")],
                                "prompt_id bigint, A_matrix_str string, B_matrix_str string, expected_C_str string")
    rows = sc.score(comps, bad, 1).select("status", "reward").collect()
    assert all(r.status == "bad_matrix" and r.reward == pytest.approx(-99.9) for r in rows)


def test_shared_compile_equals_row_compile(spark):
    from quadrant.operators import dsl
    rows = [(k, [G.STRASSEN, G.NAIVE8_STEPS, None, G.SPACED_E2][k % 4]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, script string").repartition(3)
    a = dsl.compile_shared(df, "script", "E2", per_script_columns={"n": dsl.count_by_pattern}).select("k", "prog", "n")
    b = df.select("k", dsl.compile_script("script", "E2").alias("prog"), dsl.count_by_pattern("script").alias("n"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 40


def test_completion_without_prompt_is_scored(spark, frames):
    comps, prompts = frames
    rows = sc.score(comps.withColumn("prompt_id", F.lit(7).cast("bigint")), prompts, 1).select("status", "reward").collect()
    assert len(rows) == len(CASES) and {(r.status, r.reward) for r in rows} == {("bad_matrix", -99.9)}


def test_decimal_matrices(spark):
    comps = spark.createDataFrame([(k, 0, S) for k in range(4)], "prompt_id bigint, gen_idx int, completion string")
    prompts = spark.createDataFrame([(0, "[[1.5, 0], [0, 0]]", "[[5, 6], [7, 8]]", "[[7.5, 9.0], [0, 0]]"),
                                     (1, "[[1.0, 2], [3, 4]]", "[[5, 6], [7, 8]]", "[[19.0, 22.0], [43, 50]]"),
                                     (2, "[[1.5, 0], [0, 0]]", "[[5, 6], [7, 8]]", "[[7.5, 9.5], [0, 0]]"),
                                     (3, "[[1.5, x], [0, 0]]", "[[5, 6], [7, 8]]", "[[7.5, 9.5], [0, 0]]")],
                                    "prompt_id bigint, A_matrix_str string, B_matrix_str string, expected_C_str string")
    got = {r.prompt_id: r.status for r in sc.score(comps, prompts, 1).select("prompt_id", "status").collect()}
    assert got == {0: "correct", 1: "correct", 2: "incorrect", 3: "bad_matrix"}


def test_calls_on_gapped_keys(spark):
    keys = [k * k + 3 for k in range(23)]
    df = spark.createDataFrame([(k,) for k in keys for _ in range(2)] + [(keys[5],)], "prompt_id bigint").repartition(4)
    got = {r.prompt_id: r.call for r in sc.call_ordinals(df, 4).collect()}
    assert got == {k: i // 4 for i, k in enumerate(keys)}
    full = {r.call: (r.n_prompts, r.n_completions) for r in sc.full_batches(df, 4).collect()}
    assert full == {0: (4, 8), 1: (4, 9), 2: (4, 8), 3: (4, 8), 4: (4, 8)}  # the trailing call has three prompts
    assert 1 not in {r.call for r in sc.full_batches(df, 4, generations=2).collect()}


def test_running_best_with_many_events(spark):
    n = 5_000
    df = spark.createDataFrame([(k, 0, True, n - k) for k in range(n)], "prompt_id bigint, gen_idx int, correct boolean, n_mults int")
    rows = sc.running_best(df, 4).select("prompt_id", "best_before", "is_event").collect()
    assert all(r.is_event and r.best_before == (None if r.prompt_id == 0 else n - r.prompt_id + 1) for r in rows) and len(rows) == n


def test_skewed_join_is_split(spark):
    """Half of all completions on one prompt: the join to prompts is split."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        keys = tb.deal(spark.range(40_000).selectExpr("if(id % 2 = 0, 1, id) AS prompt_id", "uuid() AS t"))
        joined = keys.join(tb.deal(spark.range(1, 40_000).withColumnRenamed("id", "prompt_id").withColumn("x", F.uuid())), "prompt_id", "left")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_group_stats(spark):
    rows = [(p, g, float((p * 7 + g * 3) % 5) - 2.0, (p + g) % 3 == 0 and p < 10, (p * g) % 4 + 5, f"s{p}{g}")
            for p in range(12) for g in range(4)]  # prompts 10, 11: no correct sample
    df = spark.createDataFrame(rows, "prompt_id bigint, gen_idx int, reward double, correct boolean, "
                                     "n_mults int, script string")
    adv = sc.advantages(df, scale=False).groupBy("prompt_id").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in adv)
    # pass@k against the closed form
    from math import comb
    got = {r.k: r.pass_at_k for r in sc.pass_at_k(df, (1, 2, 4)).collect()}
    per = {}
    for p, g, _, c, _, _ in rows:
        n, k = per.get(p, (0, 0))
        per[p] = (n + 1, k + int(c))
    for k in (1, 2, 4):
        want = sum(1 - comb(n - c, k) / comb(n, k) for n, c in per.values()) / len(per)
        assert got[k] == pytest.approx(want)
    # running best equals a brute-force scan in (call, prompt, gen) order
    rb = sc.running_best(df, 4).orderBy("call", "prompt_id", "gen_idx").collect()
    best = None
    for r in rb:
        assert r.best_before == best
        if r.correct and (best is None or r.n_mults < best):
            assert r.is_event
            best = r.n_mults
        else:
            assert not r.is_event


def test_reward_registry_and_reasoning_prep(spark):
    from quadrant.operators import evaluate as ev
    raw = spark.createDataFrame([("2+2?", "\\boxed{4}", "m", "<think>x</think><answer>$4$</answer>")],
                                "problem string, solution string, messages string, completion string")
    prepared = ev.prepare_reasoning(raw)
    assert "problem" not in prepared.columns and prepared.first().prompt[1].content == "2+2?"
    r = sc.apply_rewards(prepared, ["format", "accuracy"]).first()
    assert r.reward_format == 1.0 and r.reward_accuracy == 1.0 and r.total_reward == 2.0
    sc.register_reward("length", lambda df, out: df.withColumn(out, F.length("completion").cast("double")))
    rows = spark.createDataFrame([(f"<DSL>{S}</DSL>", *PROMPT)], "completion string, A_matrix_str string, B_matrix_str string, expected_C_str string")
    r = sc.apply_rewards(rows, ["script_v1", "script_v2", "length"]).first()
    assert (r.reward_script_v1, r.reward_script_v2) == (pytest.approx(-6.9), pytest.approx(-7.6))
    assert r.total_reward == pytest.approx(-14.5 + len(f"<DSL>{S}</DSL>"))


def test_evaluation_of_nothing_and_failed_records(spark):
    from quadrant.operators import evaluate as ev
    pair = [[[float(x) for x in row] for row in m] for m in G.M1[:2]]
    rows = spark.createDataFrame([("m", "# only a comment", *pair), ("m", G.NAIVE8_STEPS, *pair), ("m", "C[0,0] = M9", *pair)],
                                 "model string, reply string, A array<array<double>>, B array<array<double>>")
    v = ev.verify(rows, "reply", "A", "B", "E3", "stars", drop_comments=True, double_inputs=True, failed_values=False)
    got = {r.reason: r for r in v.collect()}
    assert got["no valid script"].correct is None and got["no valid script"].multiplications is None
    ok = got[None]
    assert ok.result == ok.expected == [[19.0, 22.0], [43.0, 50.0]] and ok.script == G.NAIVE8_STEPS and ok.multiplications == 8
    first = ev.verify(rows, "reply", "A", "B", "E3", "stars", double_inputs=True).where("status = 'FAILED'").collect()
    assert {(r.correct, r.efficient, r.multiplications) for r in first} == {(False, False, 0)}
    none = ev.overall_evaluation(v.limit(0)).first()
    assert (none.total_tests, none.accuracy, none.efficiency_pct) == (0, 0.0, "0.0%")
    models = spark.createDataFrame([("m",), ("idle",)], "model string")
    got = {r.model: (r.total_tests, r.accuracy_pct) for r in ev.batch_evaluation(v, models).collect()}
    assert got == {"m": (3, "33.3%"), "idle": (0, "0.0%")}


SF_SMALL = "/root/testdata/sf0.001"


def test_completions_without_a_prompt_are_run_and_verified(spark, tmp):
    from quadrant.plans import catalog
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").filter("l_orderkey < 40")
    lineitem.write.parquet(f"{tmp}/lineitem.parquet")
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter("o_orderkey < 20").write.parquet(f"{tmp}/orders.parquet")
    rows = lineitem.collect()
    lone = sorted((r.l_orderkey, r.l_linenumber - 1) for r in rows if r.l_orderkey >= 20)
    assert 0 < len(lone) < len(rows)
    ran = catalog._execute_query("E1")(spark, tmp).collect()
    assert len(ran) == len(rows)
    found = [r for r in ran if r.prompt_id >= 20]
    assert sorted((r.prompt_id, r.gen_idx) for r in found) == lone
    assert {(r.ok, r.err, r.eline, r.c00, r.c11, r.correct) for r in found} == {(False, "bad matrix", None, None, None, None)}
    assert any(r.ok and r.correct for r in ran if r.prompt_id < 20)
    verified = catalog.q_r7_verify_v1(spark, tmp).collect()
    assert sorted((r.prompt_id, r.gen_idx) for r in verified if r.prompt_id >= 20) == lone
    assert {(r.status, r.correct, r.e00) for r in verified if r.prompt_id >= 20} == {("FAILED", False, None)}
