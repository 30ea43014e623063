"""Verification of replies and evaluation summaries (R7, R7b, R8, R9, A6-A8, J3),
script lint as set operations (J5-J7), reasoning-format rewards (R5, R6),
chat rendering (P4, P9) and metric-log monitoring (W2, X19)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.functions import matrix as mx
from quadrant.functions import text as tx
from quadrant.operators import algebra, dsl
from quadrant.operators.scan import prefix_scan
from quadrant.operators.score import EFFICIENT_MAX_MULTS

# ---- fixed values -------------------------------------------------------------
# Metric-name fragments the monitor looks for, case-folded.
ENTROPY_KEY, KL_KEY, ADVANTAGE_KEY = "entropy", "kl", "advantage"
ENTROPY_EPS = 1e-8
# System prompt of the reasoning-format task.
REASONING_SYSTEM = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
    "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
    "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
    "<think> reasoning process here </think><answer> answer here </answer>"
)
# ---------------------------------------------------------------------------------


def verify(df: DataFrame, reply: str, a: str, b: str, dialect: str, counter: str,
           drop_comments: bool = False, double_inputs: bool = False, expected: str | None = None,
           failed_values: bool = True) -> DataFrame:
    """Verify a whole reply (no tag extraction): clean lines, sentinel check,
    execute, compare with the true product, count (R7 / R7b / R8).

    Adds: status SUCCESS/FAILED, reason, correct, efficient, multiplications, result,
    expected, script.  Of a FAILED reply the first evaluator reports false / 0
    (``failed_values``), the second nothing but the reason (NULL)."""
    df = df.withColumn("script", tx.clean_lines(reply, drop_comments))
    df = df.withColumn("expected", mx.product(a, b) if expected is None else F.col(expected))
    sentinel = tx.is_sentinel("script") if not drop_comments else (F.col("script") == "")
    df = df.withColumn("_sentinel", sentinel).withColumn("_valid", mx.is_2x2(a) & mx.is_2x2(b))
    df = df.withColumn("_run", F.when(~F.col("_sentinel") & F.col("_valid"), F.col("script")))
    df = dsl.run_scripts(df, "_run", dialect, a, b, "expected", out="_exec", double_inputs=double_inputs, counter=counter)
    df = df.withColumn("_n", F.col("_exec.n_mults"))
    ok = F.coalesce(F.col("_exec.ok"), F.lit(False))
    reason = (F.when(F.col("_sentinel"), F.lit("no valid script"))
              .when(~F.col("_valid"), F.lit("bad matrix"))
              .when(~ok, F.concat(F.col("_exec.err"), F.coalesce(F.concat(F.lit(" on line "), F.col("_exec.eline").cast("string")), F.lit("")))))

    def found(value: Column, failed) -> Column:
        return F.when(ok, value).otherwise(F.lit(failed if failed_values else None))
    return (df.withColumn("status", F.when(ok, F.lit("SUCCESS")).otherwise(F.lit("FAILED")))
              .withColumn("reason", reason)
              .withColumn("correct", found(F.coalesce(F.col("_exec.correct"), F.lit(False)), False))
              .withColumn("multiplications", found(F.col("_n"), 0))
              .withColumn("efficient", found(F.col("_n") <= EFFICIENT_MAX_MULTS, False))
              .withColumn("result", F.when(ok, F.col("_exec.result")))
              .withColumn("expected", F.when(ok, F.col("expected")))
              .withColumn("script", F.when(ok, F.col("script")))
              .drop("_run", "_n", "_exec", "_sentinel", "_valid"))


def end_of_run_label(verified: DataFrame) -> DataFrame:
    """passed+efficient / passed+suboptimal / incorrect / failed."""
    return verified.withColumn("label", F.when(F.col("status") == "FAILED", F.lit("failed"))
                               .when(~F.col("correct"), F.lit("incorrect"))
                               .when(F.col("efficient"), F.lit("efficient"))
                               .otherwise(F.lit("suboptimal")))


def _rates(counted: DataFrame) -> DataFrame:
    """Accuracy and efficiency of counted rows; of no tests, 0."""
    def rate(c):
        return F.coalesce(F.try_divide(F.col(c), F.col("total_tests")), F.lit(0.0))
    return (counted.withColumn("accuracy", rate("correct")).withColumn("efficiency_rate", rate("efficient"))
            .withColumn("accuracy_pct", F.format_string("%.1f%%", F.col("accuracy") * 100))
            .withColumn("efficiency_pct", F.format_string("%.1f%%", F.col("efficiency_rate") * 100)))


def _counts(*extra: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_tests"), F.count_if(F.col("correct")).alias("correct"),
            F.count_if(F.col("efficient")).alias("efficient"), *extra]


def batch_evaluation(verified: DataFrame, loaded_models: DataFrame) -> DataFrame:
    """Counts and rates per loaded model over stored replies, models
    that are not loaded skipped.  Replies are counted first (a row a model is left),
    and that summary is joined; a loaded model without tests has rate 0."""
    per_model = verified.groupBy("model").agg(*_counts())
    found = loaded_models.select("model").distinct().join(per_model, "model", "left")
    return _rates(found.fillna(0, ["total_tests", "correct", "efficient"]))


def overall_evaluation(verified: DataFrame) -> DataFrame:
    """The one-row summary of an evaluation (also of no replies at all)."""
    return _rates(verified.agg(*_counts()))


# ---- scripts x test cases (J4) --------------------------------------------------------

def script_cases(scripts: DataFrame, cases: list[tuple[list, list]], script: str = "script", dialect: str = "E4",
                 counter: str = "pattern") -> DataFrame:
    """Run every script on each of a few given matrix pairs: case_id, ok, correct,
    multiplications.  The pairs are constants of the plan: no join, and a script is
    read once for all of them, in one Arrow column."""
    pair = "array<struct<case_id:bigint,A:array<array<bigint>>,B:array<array<bigint>>>>"
    given = F.from_json(F.lit(json.dumps([{"case_id": k, "A": a, "B": b} for k, (a, b) in enumerate(cases)])), pair)
    one = scripts.sparkSession.range(0, 1, 1, 1).select(F.posexplode(given).alias("nth", "case")).select("nth", "case.*")
    cells = sorted(one.select("nth", dsl.cells_of("A", "B", "bigint").alias("longs"), dsl.cells_of("A", "B", "double").alias("doubles"),
                              F.flatten(mx.product("A", "B")).alias("expected")).collect())
    df = dsl.run_cases(scripts, [(r.longs, r.doubles, r.expected) for r in cells], script, dialect, out="_run", counter=counter)
    df = df.withColumn("multiplications", F.col("_run.n_mults"))
    others = [c for c in scripts.columns if c != script]
    df = df.select(*others, script, "multiplications", "_run", F.posexplode(given).alias("_nth", "_case"))
    return df.select(*others, script, "multiplications", "_case.*", F.coalesce("_run.ok", F.lit(False)).alias("ok"),
                     F.coalesce(F.get("_run.correct", "_nth"), F.lit(False)).alias("correct"))


def evaluation_rollup(verified: DataFrame, *levels: str) -> DataFrame:
    """2.6: counts per combination of ``levels`` and of all its prefixes in one pass, the grand total included.

    ``level`` is Spark's grouping id (a bit for each column that is summed over, the last the lowest), which tells a
    total's NULL from a NULL key."""
    return verified.rollup(*levels).agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"),
        F.count_if("efficient").alias("efficient"), F.sum(F.coalesce("multiplications", F.lit(0))).cast("bigint").alias("multiplications"))


SKETCH_LOG2 = 12  # buckets of a sketch; relative standard error 1.04 / sqrt(2^12) = 1.6 %


def distinct_sketches(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """A mergeable sketch of the distinct values per key, a few KB whatever their number."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(SKETCH_LOG2)).alias("sketch"), F.count(value).alias("n"))


def reuse_ratio(sketches: DataFrame, *keys: str) -> DataFrame:
    """Rows per distinct value, estimated from sketches merged over all but ``keys`` (BASELINE's reuse ratio)."""
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
    distinct = F.hll_sketch_estimate("sketch")
    return merged.select(*keys, "n", distinct.alias("n_distinct"), F.try_divide("n", distinct).alias("reuse"))


# ---- lint (J5, J6, J7) ---------------------------------------------------------------

def lint(df: DataFrame, key_cols: list[str], script: str = "script", dialect: str = "E1") -> DataFrame:
    """Per row: n_uses, n_undefined, first_undefined_line, n_missing_cells, from one fold over the statements
    of a script, which equal scripts of a run of rows share (see ``dsl.compile_shared``)."""
    found = dsl.per_script(df.select(*key_cols, script), script, {"found": lambda s: dsl.lint_script(s, dialect)})
    return found.select(*key_cols, "found.*")


# ---- reasoning-format rewards (R5, R6, X10) ----------------------------------------------

BOXED_RE = "\\\\boxed\\{((?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*)\\}"  # braces inside up to two deep
DOLLAR_RE = "\\$([^$]+)\\$"


def _math_value(text: Column) -> Column:
    """Extracted answer: ``\\boxed{..}`` body, else ``$..$`` body; NULL when
    neither (stands in for a LaTeX parser)."""
    boxed = F.regexp_extract(text, BOXED_RE, 1)
    dollar = F.regexp_extract(text, DOLLAR_RE, 1)
    return (F.when(text.rlike(BOXED_RE), tx.py_strip(boxed))
            .when(text.rlike(DOLLAR_RE), tx.py_strip(dollar)))


def _equivalent(a: Column, b: Column) -> Column:
    """Numeric equality when both read as numbers, else blank-insensitive
    text equality or equality as expressions (``algebra``)."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    text = F.regexp_replace(a, "\\s+", "") == F.regexp_replace(b, "\\s+", "")
    alike = algebra.same(algebra.residues(a), algebra.residues(b))
    return F.when(na.isNotNull() & nb.isNotNull(), na == nb).when(text, True).otherwise(F.coalesce(alike, F.lit(False)))


def format_reward(content) -> Column:
    """1.0 when the reply is ``<think>..</think> <answer>..</answer>``."""
    return F.when(tx.think_answer_format(content), F.lit(1.0)).otherwise(F.lit(0.0))


def accuracy_reward(content, solution) -> Column:
    """No answer block -> 0; both parse -> equivalence; neither parses ->
    exact text equality with the whole solution; one parses -> 0."""
    content, solution = tx.col(content), tx.col(solution)
    ans = tx.answer_body(content)
    gold_v, ans_v = _math_value(solution), _math_value(ans)
    return (F.when(ans.isNull(), F.lit(0.0))
            .when(gold_v.isNotNull() & ans_v.isNotNull(), F.when(_equivalent(ans_v, gold_v), 1.0).otherwise(0.0))
            .when(gold_v.isNull() & ans_v.isNull(), F.when(ans == solution, 1.0).otherwise(0.0))
            .otherwise(F.lit(0.0)))


def chat(system: Column, user: Column) -> Column:
    """[{system}, {user}] message array."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def chat_text(messages: Column) -> Column:
    """Plain-text fallback ``System: ..\\nUser: ..\\nAssistant: ``."""
    lines = F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(lines, "\n"), F.lit("\nAssistant: "))


# ---- metric-log monitor (W2, X19) ------------------------------------------------------

def first_key_containing(logs: Column, fragment: str) -> Column:
    """Value of the first map entry (insertion order) whose key
    contains ``fragment``, case-folded, and whose value is not NULL."""
    hits = F.filter(F.map_entries(logs), lambda e: (F.instr(F.lower(e["key"]), fragment) > 0) & e["value"].isNotNull())
    return F.get(hits, 0)["value"]


def metric_columns(metric_log: DataFrame) -> DataFrame:
    """The columns entropy, kl and adv of a log's metric maps."""
    return metric_log.withColumns({name: first_key_containing(F.col("logs"), fragment) for name, fragment in (
        ("entropy", ENTROPY_KEY), ("kl", KL_KEY), ("adv", ADVANTAGE_KEY))})


def entropy_monitor(metric_log: DataFrame) -> DataFrame:
    """Entropy, KL and advantage per log step, and entropy as a percent
    of the run's first logged entropy.  The baseline is a grouped aggregate
    (min_by over steps with an entropy) joined back on the run: no window
    over a whole run."""
    df = metric_columns(metric_log)
    base = (df.where(F.col("entropy").isNotNull()).groupBy("run")
            .agg(F.min_by("entropy", "step").alias("entropy0")))
    df = df.join(base, "run", "left")
    ratio = F.lit(100.0) * F.col("entropy") / (F.col("entropy0") + F.lit(ENTROPY_EPS))
    return df.withColumn("entropy_pct", F.when(F.col("entropy").isNotNull(), ratio))


def running_monitor(metric_log: DataFrame) -> DataFrame:
    """W2 as a callback sees it: ``entropy0`` at a step is the run's first entropy logged up to it (NULL before), found by a
    prefix scan, so steps may come in any order and a run may be as long as the table."""
    df = prefix_scan(metric_columns(metric_log), "first", "entropy", ["step"], "entropy0", by=["run"])
    return df.withColumn("entropy_pct", F.lit(100.0) * F.col("entropy") / (F.col("entropy0") + F.lit(ENTROPY_EPS)))


def prepare_reasoning(df: DataFrame, system: str = REASONING_SYSTEM) -> DataFrame:
    """P4 + P7 (Q1 row map): a reasoning row (problem, solution, messages, ..)
    becomes (prompt = [system, user], solution); the raw columns are dropped."""
    out = df.withColumn("prompt", chat(F.lit(system), F.col("problem")))
    return out.drop("problem", "messages")
