"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or data Spark derives from them), so its
work grows with the tables.  Doubles are rounded to 6 places and counts are
BIGINT so results compare exactly with the DuckDB oracles in
:mod:`quadrant.plans.oracles`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions import matrix as mx
from quadrant.functions import text as tx
from quadrant.operators import dsl
from quadrant.operators import evaluate as ev
from quadrant.operators import exact, lint, rewards
from quadrant.operators import score as sc
from quadrant.session import checkpoint_dir, materialize
from quadrant.sources import derive as dv
from quadrant.sources import tables as tb
from quadrant.sources.sqlgen import SPARK
from quadrant.streaming import best, monitor

Query = Callable[[SparkSession, str], DataFrame]
PROMPTS_PER_CALL = 4
GENERATIONS = 4
PASS_KS = (1, 2, 4)


def _sha(c) -> Column:
    """SHA-256 of a text, so that queries over long texts compare them whole."""
    return F.sha2((F.col(c) if isinstance(c, str) else c).cast("binary"), 256)


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- inputs ---------------------------------------------------------------------------

def prompts_with_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw matrix rows in mixed encodings derived from orders (lists, Python
    text, decimals, unreadable text, a one-row matrix, a missing side)."""
    p = tb.prompts(spark, sf)
    v = F.pmod(mx.mix("prompt_id", 300), F.lit(6))
    one_row = F.array(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    return p.select(
        "prompt_id",
        F.when(v != 4, F.col("user_query")).alias("user_query"),
        F.when(v == 0, F.col("A")).alias("matrix_A_list"),
        F.when(v == 0, F.col("B")).alias("matrix_B_list"),
        F.when(v == 1, F.col("A_matrix_str")).when(v == 2, F.lit("nope"))
         .when(v == 3, mx.py_repr(one_row))
         .when(v == 5, F.regexp_replace("A_matrix_str", r"^\[\[(-?[0-9]+)", "[[$1.50")).alias("A_matrix_str"),
        F.when(v != 0, F.col("B_matrix_str")).alias("B_matrix_str"),
    )


def prepare(raw: DataFrame, system: str = tb.SYSTEM_MESSAGE) -> DataFrame:
    """Raw row -> prompt row, with the matrix fallback chain.  Numbers
    stay text as Python prints them, so integers are exact and decimals stay decimals."""
    lists_ok = F.col("matrix_A_list").isNotNull() & F.col("matrix_B_list").isNotNull()

    def constant(v):
        return mx.matrix(*[F.lit(str(v))] * 4)

    def from_text(s):
        return F.when(F.col(s).isNotNull(), F.coalesce(mx.literal_matrix(s), constant(0)))

    def from_list(c):
        return F.col(c).cast("array<array<string>>")

    a = F.when(lists_ok, from_list("matrix_A_list")).otherwise(from_text("A_matrix_str"))
    b = F.when(lists_ok, from_list("matrix_B_list")).otherwise(from_text("B_matrix_str"))
    # (column names are case-insensitive: keep temporaries distinct)
    df = raw.withColumn("_got_a", a).withColumn("_got_b", b)
    both = F.col("_got_a").isNotNull() & F.col("_got_b").isNotNull()
    df = (df.withColumn("_use_a", F.when(both, F.col("_got_a")).otherwise(constant(1)))
            .withColumn("_use_b", F.when(both, F.col("_got_b")).otherwise(constant(1))))
    c = F.when(mx.product_ok("_use_a") & mx.product_ok("_use_b"), mx.literal_product("_use_a", "_use_b")).otherwise(constant(0))
    user = F.coalesce(F.col("user_query"), F.lit(tb.DEFAULT_USER_PROMPT))
    return df.select(
        "prompt_id",
        ev.chat(F.lit(system), user).alias("prompt"),
        mx.literal_repr("_use_a").alias("A_matrix_str"), mx.literal_repr("_use_b").alias("B_matrix_str"),
        mx.literal_repr(c).alias("expected_C_str"))


def scoring_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for scoring; some have their first matrix written with decimals."""
    p = tb.prompts(spark, sf)
    decimals = F.pmod(mx.mix("prompt_id", 700), F.lit(9)) == 0
    return p.withColumn("A_matrix_str", F.when(decimals, F.regexp_replace("A_matrix_str", "([0-9]+)", "$1.0"))
                        .otherwise(F.col("A_matrix_str")))


def scored(spark: SparkSession, sf: str, version: int) -> DataFrame:
    return sc.score(tb.completions(spark, sf), scoring_prompts(spark, sf), version=version)


def with_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return tb.completions(spark, sf).withColumn("script", tx.script_from_completion("completion"))


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training-log events from ``events``: run by user bucket, step = event
    id, one metric per event type plus a constant learning rate."""
    e = tb.read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value"])
    key = (F.when(F.col("event_type") == "view", "train/entropy").when(F.col("event_type") == "click", "train/kl")
           .when(F.col("event_type") == "error", "train/advantage_mean")
           .when(F.col("event_type") == "purchase", "train/reward").otherwise("train/loss"))
    return e.select(F.concat(F.lit("run-"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("run"),
                    F.col("event_id").alias("step"),
                    F.create_map(F.lit("old/entropy"), F.lit(None).cast("double"), key, F.col("value"),
                                 F.lit("train/learning_rate"), F.lit(2e-6)).alias("logs"))


def reasoning_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns wrapped in think/answer variants with a solution."""
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    c = c.where(F.col("role") == "assistant").withColumn("_k", F.col("conv_id") * 16 + F.col("turn"))
    n = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10)).cast("string")
    base = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think><answer>"), n, F.lit("</answer>"))
    v = F.pmod(mx.mix("_k", 400), F.lit(6))
    content = (F.when(v == 0, base).when(v == 1, F.concat(F.lit(" "), base))
               .when(v == 2, F.concat(base, F.lit("\n"))).when(v == 3, F.concat(base, F.lit("\r\n")))
               .when(v == 4, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>")))
               .otherwise(F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n<answer>$"), n, F.lit("$</answer>"))))
    s = F.pmod(mx.mix("_k", 401), F.lit(3))
    n2 = F.pmod(F.col("conv_id") * 7 + F.col("turn") + 1, F.lit(10)).cast("string")
    solution = (F.when(s == 0, F.concat(F.lit("\\boxed{"), n, F.lit("}")))
                .when(s == 1, F.concat(F.lit("$"), n2, F.lit("$"))).otherwise(F.concat(F.lit("answer "), n)))
    return c.select("conv_id", "turn", content.alias("content"), solution.alias("solution"))


def answered_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Completions joined with the solutions table on their key."""
    completions = reasoning_turns(spark, sf).select("conv_id", "turn", "content")
    solutions = reasoning_turns(spark, sf).select("conv_id", "turn", "solution")
    return completions.join(solutions, ["conv_id", "turn"], "left")


# ---- queries ---------------------------------------------------------------------------

def q_x1_clean_text(spark, sf):
    d = tb.read_table(spark, sf, "documents", ["doc_id", "text"])
    d = d.withColumn("clean", tx.clean_lines(tx.remove_tokens("text")))
    return d.select("doc_id",
                    F.size(tx.split_lines("text")).cast("bigint").alias("n_lines"),
                    F.size(tx.clean_line_array("text")).cast("bigint").alias("n_clean"),
                    F.size(tx.clean_line_array("text", drop_comments=True)).cast("bigint").alias("n_code"),
                    F.length("clean").cast("bigint").alias("clean_len"), _sha("clean").alias("clean_sha256"),
                    dsl.count_stars("text").cast("bigint").alias("stars"))


def q_f5_tag_extract(spark, sf):
    c = with_scripts(spark, sf).withColumn("body", tx.tag_body("completion"))
    return c.select("prompt_id", "gen_idx", tx.has_tag("completion").alias("tagged"),
                    F.length("body").cast("bigint").alias("body_len"), _sha("body").alias("body_sha256"),
                    F.length("script").cast("bigint").alias("script_len"), _sha("script").alias("script_sha256"),
                    F.size(tx.clean_line_array("script")).cast("bigint").alias("n_lines"),
                    tx.is_sentinel("script").alias("empty"))


def q_r1_reply_extract(spark, sf):
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev_text"))
    a = c.where(F.col("role") == "assistant").join(prev, ["conv_id", "turn"], "left")   # previous turn by key
    marker = F.lit("<|im_start|>assistant")
    prompt = F.concat(F.lit("<|im_start|>user\n"), F.coalesce("prev_text", F.lit("")), F.lit("<|im_end|>\n"), marker, F.lit("\n"))
    v = F.pmod(mx.mix(F.col("conv_id") * 16 + F.col("turn"), 500), F.lit(5))
    full = (F.when(v == 0, F.concat(prompt, F.col("text"), F.lit("<|im_end|>")))
            .when(v == 1, F.concat(F.lit("preamble "), prompt, F.col("text"), F.lit("<|endoftext|>")))
            .when(v == 2, F.col("text"))
            .when(v == 3, F.concat(prompt, F.col("text"), F.lit("<|im_end|><|endoftext|>")))
            .otherwise(F.concat(F.lit("preamble "), prompt, F.col("text"), marker)))  # last marker ends the text
    df = a.withColumn("_prompt", prompt).withColumn("_full", full)
    return df.select("conv_id", "turn", tx.reply_from_generation("_full", "_prompt").alias("reply"))


def q_g1_matrix_pairs(spark, sf):
    p = tb.prompts(spark, sf)
    return p.select("prompt_id", "user_query", "A_matrix_str", "B_matrix_str", "expected_C_str")


def q_p1_prepare_prompts(spark, sf):
    p = prepare(prompts_with_raw(spark, sf))
    return p.select("prompt_id", "A_matrix_str", "B_matrix_str", "expected_C_str",
                    F.get(F.col("prompt"), 1)["content"].alias("user_content"),
                    F.aggregate(F.col("prompt"), F.lit(0).cast("bigint"),
                                lambda acc, m: acc + F.length(m["content"])).alias("prompt_chars"),
                    _sha(F.array_join(F.transform("prompt", lambda m: F.concat_ws("\n", m["role"], m["content"])), "\n")).alias("prompt_sha256"))


def q_f4_valid_matrices(spark, sf):
    raw = prompts_with_raw(spark, sf)
    a = F.coalesce(F.col("matrix_A_list").cast("array<array<double>>"), mx.parse_matrix("A_matrix_str", "double"))
    return raw.select("prompt_id", mx.is_2x2(a).alias("a_valid"), mx.product_ok(a).alias("a_product_ok"))


def q_r10_parse_matrices(spark, sf):
    p = tb.prompts(spark, sf)
    v = F.pmod(mx.mix("prompt_id", 600), F.lit(3))
    text = (F.when(v == 0, F.concat(F.lit("Multiply "), mx.compact_repr("A"), F.lit(" by "), mx.compact_repr("B")))
            .when(v == 1, F.concat(F.lit("A = "), F.col("A_matrix_str"), F.lit("\nB = "), F.col("B_matrix_str"), F.lit(" please")))
            .otherwise(F.concat(F.lit("only "), mx.compact_repr("A"))))
    m = mx.matrices_from_text(text)
    default = {x: F.col(x).cast("array<array<double>>") for x in ("A", "B")}  # a random pair: the prompt's own
    cells = [(f"{x.lower()}{r}{c}", mx.at(F.coalesce(m[x], default[x]), r, c)) for x in ("A", "B") for r in (0, 1) for c in (0, 1)]
    return p.select("prompt_id", m.isNotNull().alias("found"), *[col.alias(n) for n, col in cells])


def _counter_query(counter):
    def q(spark, sf):
        c = with_scripts(spark, sf).select("prompt_id", "gen_idx", "script")

        def n(script):
            return dsl.COUNTERS[counter](script).cast("bigint")
        return c.select("prompt_id", "gen_idx", n("script").alias("n"))
    return q


def _execute_query(dialect):
    """A completion without a prompt has nothing to run on: not ok, 'bad matrix'."""
    def q(spark, sf):
        c = with_scripts(spark, sf)
        p = tb.prompts(spark, sf).select("prompt_id", "A", "B", "C")
        df = dsl.run_scripts(c.drop("completion").join(p, "prompt_id", "left"), "script", dialect, "A", "B", "C")
        found = F.col("A").isNotNull() & F.col("B").isNotNull()
        res = F.when(found, F.col("exec.result"))
        return df.select("prompt_id", "gen_idx", F.when(found, F.col("exec.ok")).otherwise(F.lit(False)).alias("ok"),
                         F.when(found, F.col("exec.err")).otherwise(F.lit("bad matrix")).alias("err"),
                         F.when(found, F.col("exec.eline")).alias("eline"),
                         *[mx.at(res, r, c).alias(f"c{r}{c}") for r in (0, 1) for c in (0, 1)],
                         F.when(found, F.col("exec.correct")).alias("correct"))
    return q


def _reward_query(version):
    def q(spark, sf):
        s = scored(spark, sf, version)
        return s.select("prompt_id", "gen_idx", "status", F.col("n_mults").cast("bigint").alias("n_mults"),
                        _r(F.col("reward")).alias("reward"))
    return q


def q_a14_status_tally(spark, sf):
    return sc.status_tally(scored(spark, sf, 1)).select("status", F.col("n").cast("bigint").alias("n"))


def q_a4_batch_mean(spark, sf):
    b = sc.batch_means(scored(spark, sf, 1), PROMPTS_PER_CALL)
    return b.select("call", F.col("n").cast("bigint").alias("n"), _r(F.col("mean_reward")).alias("mean_reward"))


def q_a5_best_script(spark, sf):
    b = sc.best_script(scored(spark, sf, 2))
    return b.select(F.col("best_n_mults").cast("bigint").alias("best_n_mults"), "best_script",
                    F.col("n_correct").cast("bigint").alias("n_correct"))


def q_a12_advantage(spark, sf):
    a = sc.advantages(scored(spark, sf, 2).select("prompt_id", "gen_idx", "reward"))
    return a.select("prompt_id", "gen_idx", _r(F.col("reward")).alias("reward"),
                    _r(F.col("group_mean")).alias("group_mean"), _r(F.col("advantage"), 4).alias("advantage"))


def q_a13_pass_at_k(spark, sf):
    p = sc.pass_at_k(scored(spark, sf, 2), PASS_KS)
    return p.select(F.col("k").cast("bigint").alias("k"), F.col("n_prompts").cast("bigint").alias("n_prompts"),
                    _r(F.col("pass_at_k"), 9).alias("pass_at_k"))


def q_w1_running_best(spark, sf):
    w = sc.running_best(scored(spark, sf, 2).select("prompt_id", "gen_idx", "correct", "n_mults"), PROMPTS_PER_CALL)
    return w.select("prompt_id", "gen_idx", "call", F.col("best_before").cast("bigint").alias("best_before"),
                    "is_event")


def q_z1_best_stream(spark, sf):
    """Completions replayed through the scoring stream in three available-now runs: the strict improvements."""
    folder = f"{checkpoint_dir(spark)}/best-stream-{uuid.uuid4().hex}"
    found = best.replay(tb.completions(spark, sf), scoring_prompts(spark, sf), folder)
    return found.select("prompt_id", "gen_idx", F.col("n_mults").cast("bigint").alias("n_mults"), "script")


def q_w5_full_batches(spark, sf):
    """On keys with gaps: ordinals come from ranks, not from the keys' values."""
    li = tb.read_table(spark, sf, "lineitem", ["l_orderkey"])
    gapped = li.select((F.col("l_orderkey") * 5 + F.col("l_orderkey") % 3).alias("prompt_id"))
    b = sc.full_batches(gapped, PROMPTS_PER_CALL)
    return b.select("call", F.col("n_prompts").cast("bigint").alias("n_prompts"),
                    F.col("n_completions").cast("bigint").alias("n_completions"))


def q_a11_reward_sum(spark, sf):
    c = tb.completions(spark, sf).withColumn("format", ev.format_reward("completion"))
    s = sc.reward_sum(sc.score(c, scoring_prompts(spark, sf), 2), ["reward", "format"])
    return s.select("prompt_id", "gen_idx", _r(F.col("total_reward")).alias("total_reward"))


def q_p10_expand_generations(spark, sf):
    p = tb.prompts(spark, sf)
    return p.select("prompt_id", F.explode(F.sequence(F.lit(0), F.lit(GENERATIONS - 1))).alias("gen_idx"),
                    F.length("user_query").cast("bigint").alias("query_len"), _sha("user_query").alias("query_sha256"))


def q_j6_lint(spark, sf):
    c = with_scripts(spark, sf)
    out = ev.lint(c, ["prompt_id", "gen_idx"], "script", "E1")
    return out.select("prompt_id", "gen_idx", F.col("n_uses").cast("bigint").alias("n_uses"),
                      F.col("n_undefined").cast("bigint").alias("n_undefined"),
                      F.col("first_undefined_line").cast("bigint").alias("first_undefined_line"),
                      F.col("n_missing_cells").cast("bigint").alias("n_missing_cells"))


CHECK_PRIME = 998_244_353  # not one of the primes that exact results are computed with


def q_d5_exact_results(spark, sf):
    """Exact results in decimal text, beyond BIGINT too, each cell shown by its residue modulo a prime and its last nine digits
    (of the least non-negative residue), both read from the text."""
    c = with_scripts(spark, sf).drop("completion")
    p = tb.prompts(spark, sf).select("prompt_id", "A", "B")
    df = dsl.compile_shared(c.join(p, "prompt_id"), "script", "E1")
    df = exact.with_exact_results(df)
    cells = [F.element_at("exact", k + 1) for k in range(4)]
    return df.select("prompt_id", "gen_idx", *[dsl.digits_mod(cell, m).alias(f"c{rc}_{name}") for cell, rc in zip(cells, ("00", "01", "10", "11"))
                                               for name, m in (("prime", CHECK_PRIME), ("digits", 10 ** 9))])


def q_d1_script_dictionary(spark, sf):
    """Every different script once, compiled once for the whole table, with its number of rows."""
    found = dsl.script_dictionary(with_scripts(spark, sf).select("script"), "script", "E1",
                                  columns={"n": dsl.COUNTERS["pattern"]})
    return found.select("script_hash", "n_rows", F.col("prog.ok").alias("ok"), F.col("prog.err").alias("err"),
                        F.col("prog.eline").alias("eline"), F.col("n").cast("bigint").alias("multiplications"))


def q_j5_def_use(spark, sf):
    """Reads matched with the definitions they see by the as-of join, summed per completion."""
    out = lint.lint(with_scripts(spark, sf), ["prompt_id", "gen_idx"])
    return out.select("prompt_id", "gen_idx", *[F.col(c).cast("bigint").alias(c) for c in (
        "n_uses", "n_undefined", "first_undefined_line", "n_missing_cells", "sum_distance", "max_distance")])


def _verify_v1(spark, sf, counter):
    c = tb.completions(spark, sf)
    p = tb.prompts(spark, sf).select("prompt_id", "A", "B", "C")
    v = ev.verify(c.join(p, "prompt_id", "left").withColumnRenamed("completion", "reply"), "reply", "A", "B", "E1", counter, expected="C")
    return v.drop("reply")


def _record(v: DataFrame) -> list:
    """The verification record's matrices, a column a cell."""
    return [mx.at(m, r, c).alias(f"{m[0]}{r}{c}") for r in (0, 1) for c in (0, 1) for m in ("result", "expected")]


def q_r7_verify_v1(spark, sf):
    v = _verify_v1(spark, sf, "pattern")
    return v.select("prompt_id", "gen_idx", "status", "correct", "efficient",
                    F.col("multiplications").cast("bigint").alias("multiplications"), "script", *_record(v))


def _summary(s: DataFrame, *keys: str) -> DataFrame:
    return s.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("total_tests", "correct", "efficient")],
                    _r(F.col("accuracy")).alias("accuracy"), _r(F.col("efficiency_rate")).alias("efficiency_rate"),
                    "accuracy_pct", "efficiency_pct")


def q_r7_summary(spark, sf):
    return _summary(ev.overall_evaluation(_verify_v1(spark, sf, "pattern")))


def q_r7b_verify_end(spark, sf):
    v = ev.end_of_run_label(_verify_v1(spark, sf, "product_lines"))
    return v.select("prompt_id", "gen_idx", "label", F.col("multiplications").cast("bigint").alias("multiplications"))


def verified_responses(spark, sf):
    r = tb.responses(spark, sf)
    return ev.verify(r, "response", "A", "B", "E3", "stars", drop_comments=True, double_inputs=True,
                     failed_values=False)


def q_r8_verify_v2(spark, sf):
    v = verified_responses(spark, sf)
    return v.select("test_id", "attempt", "model", "status", "reason", "correct", "efficient",
                    F.col("multiplications").cast("bigint").alias("multiplications"), "script", *_record(v))


def loaded_models(spark, sf):
    """Most brands, and a model that no reply is stored of."""
    part = tb.read_table(spark, sf, "part", ["p_brand"])
    brands = part.where(~F.col("p_brand").endswith("5")).select(F.col("p_brand").alias("model")).distinct()
    return brands.union(spark.createDataFrame([("untested",)], "model string"))


def q_r9_batch_eval(spark, sf):
    return _summary(ev.batch_evaluation(verified_responses(spark, sf), loaded_models(spark, sf)), "model")


def q_r9_overall(spark, sf):
    return _summary(ev.overall_evaluation(verified_responses(spark, sf)))


# The matrix pairs that a script is tried on.
SCRIPT_CASES = [([[1, 2], [3, 4]], [[5, 6], [7, 8]]), ([[2, 1], [1, 2]], [[3, 1], [2, 3]]), ([[1, 0], [0, 1]], [[5, 6], [7, 8]])]


def q_j4_script_cases(spark, sf):
    t = ev.script_cases(with_scripts(spark, sf).drop("completion"), SCRIPT_CASES)
    return t.select("prompt_id", "gen_idx", "case_id", "ok", "correct", F.col("multiplications").cast("bigint").alias("multiplications"))


def q_p8_inference_prompt(spark, sf):
    p = tb.prompts(spark, sf)
    return p.select("prompt_id", tx.inference_prompt("user_query", "A", "B").alias("using_prompt"),
                    tx.inference_prompt("user_query", "A", "B", "lines").alias("lines_prompt"))


MASK_LIMIT = 40  # words of a completion at which it counts as cut off


def q_p11_normalize(spark, sf):
    """P11 on message lists of one or two, F10 (messages without content are left out, the others
    keep their keys) and F11 (long completions are masked)."""
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    v = F.pmod(mx.mix(F.col("conv_id") * 16 + F.col("turn"), 800), F.lit(4))
    message = F.struct("role", F.when(v < 2, F.col("text")).alias("content"))
    after = F.struct(F.lit("user").alias("role"), F.lit("next").alias("content"))
    c = c.withColumn("raw", F.when(v == 1, F.array(message, after)).otherwise(F.array(message)))
    c = sc.with_content(tx.normalize_completion(c, "raw"), "raw")
    c = c.withColumn("n_tokens", F.size(F.split("text", " ", -1))).withColumn("advantage", F.lit(1.0))
    c = sc.truncation_mask(c, "n_tokens", MASK_LIMIT)
    return c.select("conv_id", "turn", "completion", (F.col("n_tokens") >= MASK_LIMIT).alias("truncated"),
                    F.col("masked_advantage").alias("masked"))


def q_p11_mixed_shapes(spark, sf):
    """P11 / X20 on one column of JSON completions whose shape differs from row to row: text, a message, a list of one
    of either, longer and empty lists, an object without content, a number, null, and lines that are no JSON."""
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    k = F.pmod(mx.mix(F.col("conv_id") * 16 + F.col("turn"), 801), F.lit(10))
    message = F.struct(F.col("text").alias("content"), "role")
    quoted = F.to_json(F.array("text"))
    raw = (F.when(k == 0, F.substring(quoted, F.lit(2), F.length(quoted) - 2))
           .when(k == 1, F.to_json(message)).when(k == 2, quoted).when(k == 3, F.to_json(F.array(message)))
           .when(k == 4, F.to_json(F.array(F.col("role"), F.col("role")))).when(k == 5, F.lit("[]"))
           .when(k == 6, F.to_json(F.struct("role"))).when(k == 7, F.col("turn").cast("string"))
           .when(k == 8, F.lit("null")).otherwise(F.concat(F.lit("{"), F.col("text"))))
    return c.select("conv_id", "turn", tx.normalize_json(raw).alias("completion"))


THINK_ANSWER = re.compile(r"^<think>.*?</think>\s*<answer>.*?</answer>$", re.DOTALL)


def python_format_reward(completions, **_):
    """R5 as a user would write it."""
    return [1.0 if THINK_ANSWER.match(c) else 0.0 for c in completions]


def python_share_reward(completions, conv_id, **_):
    """Raises on every fifth conversation."""
    return [1.0 / (k % 5) for k in conv_id]


def q_q2_user_rewards(spark, sf):
    """Two users' functions in one Arrow pass beside the built-in format reward; one of them fails on some rows."""
    t = reasoning_turns(spark, sf).withColumn("builtin", ev.format_reward("content"))
    r = rewards.with_user_rewards(t, {"format": python_format_reward, "share": python_share_reward}, "content", ["conv_id"])
    total = F.col("reward_format") + F.coalesce("reward_share", F.lit(0.0))
    return r.select("conv_id", "turn", "builtin", "reward_format", _r(F.col("reward_share")).alias("reward_share"),
                    "error_share", _r(total).alias("total"))


def q_a14_observed(spark, sf):
    """Tally, mean and best of the scored rows, observed while these are written."""
    rows = scored(spark, sf, 2).select("prompt_id", "gen_idx", "status", "reward", "correct", "n_mults")
    m = sc.write_observed(rows, f"{checkpoint_dir(spark)}/scored-{uuid.uuid4().hex}")
    return spark.createDataFrame([(*[m[s] for s in sc.STATUSES], m["n"], m["best_n_mults"], round(m["mean_reward"], 6) if m["n"] else None)],
                                 ", ".join(f"{s} long" for s in sc.STATUSES) + ", n long, best_n_mults long, mean_reward double")


def q_a8_rollup(spark, sf):
    """Verified replies counted per (model, status), per model and over all, in one pass."""
    v = verified_responses(spark, sf)
    return ev.evaluation_rollup(v.withColumn("correct", F.coalesce("correct", F.lit(False))).withColumn(
        "efficient", F.coalesce("efficient", F.lit(False))), "model", "status")


def q_a10_reuse_sketch(spark, sf):
    """Distinct scripts by merged sketches (per generation, then over all), against the exact count."""
    c = materialize(with_scripts(spark, sf).select("gen_idx", "script"))
    kept = materialize(ev.distinct_sketches(c, "script", "gen_idx"))
    both = ev.reuse_ratio(kept, "gen_idx").unionByName(ev.reuse_ratio(kept.withColumn("gen_idx", F.lit(-1)), "gen_idx"))
    exact_counts = (c.groupBy("gen_idx").agg(F.count_distinct("script").alias("n_exact"))
                    .unionByName(c.agg(F.count_distinct("script").alias("n_exact")).withColumn("gen_idx", F.lit(-1))))
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.ceil(F.col("n_exact") * 0.05)  # three standard errors
    return both.join(exact_counts, "gen_idx").select(F.col("gen_idx").cast("bigint").alias("gen_idx"), "n", "n_exact", close.alias("within"))


def _quarters(n):
    """n / 4 as a decimal."""
    return F.concat(F.floor(n / 4).cast("string"), F.lit("."), F.lpad((F.pmod(n, F.lit(4)) * 25).cast("string"), 2, "0"))


def q_r6_symbolic(spark, sf):
    """R6 on answers that are expressions, the solution spelled in another way or (every third) of another value."""
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role"]).where(F.col("role") == "assistant")
    key = F.col("conv_id") * 7 + F.col("turn")
    n, off, k = F.pmod(key, F.lit(10)), F.when(F.pmod(key, F.lit(3)) == 0, F.lit(1)).otherwise(F.lit(0)), F.pmod(key, F.lit(7))
    s = n.cast("string")

    def t(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    answer = (F.when(k == 0, t(r"\frac{", s, "}{4}")).when(k == 1, t("(x+", s, ")^2")).when(k == 2, t(r"\sqrt{", n * n * 2, "}"))
              .when(k == 3, t("2^{", s, "}")).when(k == 4, t("(a+b)(a-", s, ")")).when(k == 5, t(s)).otherwise(t("answer ", s)))
    solution = (F.when(k == 0, _quarters(n + off)).when(k == 1, t("x^2+", n * 2, "x+", n * n + off))
                .when(k == 2, t(n + off, r"\sqrt{2}")).when(k == 3, t((F.pow(F.lit(2), n) + off).cast("bigint")))
                .when(k == 4, t("a^2+ab-", s, "a-", n + off, "b")).when(k == 5, t("x = ", n + off)).otherwise(t("answer ", n + off)))
    rows = c.select("conv_id", "turn", t("<answer>$", answer, "$</answer>").alias("content"), t(r"\boxed{", solution, "}").alias("solution"))
    return rows.select("conv_id", "turn", ev.accuracy_reward("content", "solution").alias("reward"))


def q_u1_remove_tokens(spark, sf):
    tokens = tx.token_list(["<|im_end|>", None, "", "<DSL>"])  # a tokenizer's own, with repeats
    c = tb.completions(spark, sf)
    c = c.withColumn("plain", tx.remove_tokens("completion", tokens))
    return c.select("prompt_id", "gen_idx", F.length("plain").cast("bigint").alias("n_chars"), _sha("plain").alias("text_sha256"))


def q_w2_entropy_ratio(spark, sf):
    m = ev.entropy_monitor(metric_log(spark, sf))
    return m.select("run", "step", _r(F.col("entropy")).alias("entropy"), _r(F.col("kl")).alias("kl"),
                    _r(F.col("adv")).alias("adv"), _r(F.col("entropy_pct")).alias("entropy_pct"))


def q_w2_running_baseline(spark, sf):
    """The baseline as known at each step, by a prefix scan."""
    m = ev.running_monitor(metric_log(spark, sf))
    return m.select("run", "step", _r(F.col("entropy0")).alias("entropy0"), _r(F.col("entropy_pct")).alias("entropy_pct"))


def q_z2_metric_stream(spark, sf):
    """The log of W2, replayed through the stateful monitor in four available-now runs of its stream."""
    folder = f"{checkpoint_dir(spark)}/metric-stream-{uuid.uuid4().hex}"
    m = monitor.replay(metric_log(spark, sf), folder)
    return m.select("run", "step", *[_r(F.col(c)).alias(c) for c in ("entropy", "kl", "adv", "entropy_pct")])


def q_r5_format_reward(spark, sf):
    t = reasoning_turns(spark, sf)
    return t.select("conv_id", "turn", ev.format_reward("content").alias("format_reward"))


def q_r6_answer_reward(spark, sf):
    t = answered_turns(spark, sf)
    return t.select("conv_id", "turn", tx.answer_body("content").alias("answer"),
                    ev.accuracy_reward("content", "solution").alias("accuracy_reward"))


def q_p9_chat_text(spark, sf):
    c = tb.read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    system = (c.where(F.col("role") == "system").groupBy("conv_id")  # the first system turn of a conversation
              .agg(F.min_by("text", "turn").alias("system_text")))
    users = c.where(F.col("role") == "user").join(system, "conv_id", "left")   # equi-join, not a collect
    system_text = F.coalesce(F.col("system_text"), F.lit(ev.REASONING_SYSTEM))
    return users.select("conv_id", "turn", ev.chat_text(ev.chat(system_text, F.col("text"))).alias("chat"),
                        tx.basic_chat_text(system_text, "text").alias("basic"))


def q_g6_program_corpus(spark, sf):
    return tb.programs(spark, sf).select("program_id", "prompt", "completion")


def queries() -> dict[str, Query]:
    q = {
        "x1_clean_text": q_x1_clean_text,
        "f5_tag_extract": q_f5_tag_extract,
        "r1_reply_extract": q_r1_reply_extract,
        "g1_matrix_pairs": q_g1_matrix_pairs,
        "p1_prepare_prompts": q_p1_prepare_prompts,
        "f4_valid_matrices": q_f4_valid_matrices,
        "r10_parse_matrices": q_r10_parse_matrices,
        "a1_star_count": _counter_query("stars"),
        "a2_mult_count": _counter_query("pattern"),
        "a3_mult_lines": _counter_query("product_lines"),
        "d5_execute_e1": _execute_query("E1"),
        "d5_execute_e2": _execute_query("E2"),
        "d5_execute_e3": _execute_query("E3"),
        "d5_execute_e4": _execute_query("E4"),
        "j5_def_use": q_j5_def_use,
        "j6_lint": q_j6_lint,
        "r3_reward_v1": _reward_query(1),
        "r4_reward_v2": _reward_query(2),
        "a14_status_tally": q_a14_status_tally,
        "a4_batch_mean": q_a4_batch_mean,
        "a5_best_script": q_a5_best_script,
        "a12_advantage": q_a12_advantage,
        "a13_pass_at_k": q_a13_pass_at_k,
        "w1_running_best": q_w1_running_best,
        "w5_full_batches": q_w5_full_batches,
        "a11_reward_sum": q_a11_reward_sum,
        "p10_expand_generations": q_p10_expand_generations,
        "r7_verify_v1": q_r7_verify_v1,
        "r7b_verify_end": q_r7b_verify_end,
        "r8_verify_v2": q_r8_verify_v2,
        "r9_batch_eval": q_r9_batch_eval,
        "w2_entropy_ratio": q_w2_entropy_ratio,
        "w2_running_baseline": q_w2_running_baseline,
        "z1_best_stream": q_z1_best_stream,
        "z2_metric_stream": q_z2_metric_stream,
        "r5_format_reward": q_r5_format_reward,
        "r6_answer_reward": q_r6_answer_reward,
        "p9_chat_text": q_p9_chat_text,
        "g6_program_corpus": q_g6_program_corpus,
        "d1_script_dictionary": q_d1_script_dictionary,
        "d5_exact_results": q_d5_exact_results,
        "j4_script_cases": q_j4_script_cases,
        "r7_summary": q_r7_summary,
        "r9_overall": q_r9_overall,
        "p8_inference_prompt": q_p8_inference_prompt,
        "p11_normalize": q_p11_normalize,
        "p11_mixed_shapes": q_p11_mixed_shapes,
        "r6_symbolic": q_r6_symbolic,
        "q2_user_rewards": q_q2_user_rewards,
        "a14_observed": q_a14_observed,
        "a8_rollup": q_a8_rollup,
        "a10_reuse_sketch": q_a10_reuse_sketch,
        "u1_remove_tokens": q_u1_remove_tokens,
    }
    return q
