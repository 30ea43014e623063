"""Rewards and group statistics over scored completions.

Every function is a DataFrame -> DataFrame transformation.  Group statistics
use ``groupBy`` (partial aggregation before the shuffle, so a hot group is
collapsed map-side) and join back, instead of windows over groups that may be
arbitrarily large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quadrant.functions import matrix as mx
from quadrant.functions import text as tx
from quadrant.operators import dsl
from quadrant.operators.scan import prefix_scan
from quadrant.session import materialize

# ---- fixed values: reward constants -------------------------------------------
TAG_BONUS = 0.1
MULT_PENALTY = -1.0
WRONG_ANSWER_PENALTY = -100.0
SHAPING_COEFF = -0.1          # v2: extra per-multiplication term
EFFICIENT_MAX_MULTS = 7
ADV_EPS = 1e-4                # advantage scaling epsilon
# ---------------------------------------------------------------------------------

STATUSES = ("correct", "incorrect", "failed", "empty", "bad_matrix")


def matrices_from_strings(df: DataFrame, a: str = "A_matrix_str", b: str = "B_matrix_str",
                          c: str = "expected_C_str") -> DataFrame:
    """Decode the prompt's matrix strings (X14): A, B, E as integers (NULL when
    they are none) and Ad, Bd, Ed as doubles (NULL when unreadable, T6)."""
    for name, text in (("A", a), ("B", b), ("E", c)):
        df = df.withColumn(name, mx.parse_matrix(text)).withColumn(f"{name}d", mx.parse_matrix(text, "double"))
    return df


def extract_script(df: DataFrame, content: str = "completion", version: int = 1, tokens=None) -> DataFrame:
    """R2: tag flag, clean script, tag bonus, empty/sentinel flag; a text is read once."""
    df = df.withColumn("_found", tx.tagged_script(content, tokens)).withColumn("tagged", F.coalesce("_found.tagged", F.lit(False)))
    df = df.withColumn("script", F.col("_found.script")).drop("_found")
    bonus = F.when(F.col("tagged"), F.lit(TAG_BONUS)).otherwise(F.lit(0.0))
    if version == 2:  # an empty tag body earns no bonus
        bonus = F.when(F.col("script") == "", F.lit(0.0)).otherwise(bonus)
    return df.withColumn("tag_bonus", bonus).withColumn("empty", tx.is_sentinel("script"))


def reward_expr(status: Column, n: Column, bonus: Column, version: int) -> Column:
    """Reward in the reference's floating-point operation order."""
    nd = n.cast("double")
    if version == 1:
        right = nd * F.lit(MULT_PENALTY) + bonus
        wrong = F.lit(WRONG_ANSWER_PENALTY) + bonus
    else:
        shaping = F.lit(SHAPING_COEFF) * nd
        right = (nd * F.lit(MULT_PENALTY) + shaping) + bonus
        wrong = (F.lit(WRONG_ANSWER_PENALTY) + (nd * F.lit(MULT_PENALTY) + shaping)) + bonus
    return (F.when(status == "bad_matrix", F.lit(WRONG_ANSWER_PENALTY) + F.lit(TAG_BONUS))
            .when(status == "correct", right)
            .when(status == "incorrect", wrong)
            .otherwise(F.lit(WRONG_ANSWER_PENALTY) + bonus))


def score(completions: DataFrame, prompts: DataFrame, version: int = 1, counter: str = "pattern", tokens=None) -> DataFrame:
    """Score each completion against its prompt (L2: J1 -> R2 -> D -> R3/R4).

    ``completions``: prompt_id, gen_idx, completion, and any columns to carry along;
    ``prompts``: prompt_id, A_matrix_str, B_matrix_str, expected_C_str.  Version 1
    runs dialect E1, version 2 dialect E2 with the shaping term.  A completion
    without a prompt has no readable matrices (status ``bad_matrix``).  The
    completion's text itself is not carried along; its clean ``script`` is."""
    p = prompts.select("prompt_id", "A_matrix_str", "B_matrix_str", "expected_C_str")
    df = extract_script(completions, "completion", version, tokens).drop("completion")
    p = matrices_from_strings(p).drop("A_matrix_str", "B_matrix_str", "expected_C_str")  # once a prompt, not once a completion
    return score_rows(df.join(p, "prompt_id", "left"), version, counter)  # J1 (equi-join on the key)


def score_rows(df: DataFrame, version: int, counter: str = "pattern") -> DataFrame:
    """Run, compare and reward rows that hold a script and its matrices."""
    readable = F.col("Ad").isNotNull() & F.col("Bd").isNotNull() & F.col("Ed").isNotNull()
    valid = mx.is_2x2("Ad") & mx.is_2x2("Bd")
    df = df.withColumn("readable", readable).withColumn("valid", valid)
    df = df.withColumn("_run_script", F.when(F.col("readable") & ~F.col("empty") & F.col("valid"), F.col("script")))
    floating = F.col("A").isNull() | F.col("B").isNull() | F.col("E").isNull()
    df = dsl.run_scripts(df, "_run_script", "E1" if version == 1 else "E2", "A", "B", "E", out="exec", doubles=("Ad", "Bd", "Ed"),
                         floating=floating, counter=counter)
    # the count is only read for runnable rows (others score without it)
    df = df.withColumn("n_mults", F.coalesce(F.col("exec.n_mults"), F.lit(0))).drop("_run_script")
    e = F.col("Ed")
    e_shape = (F.size(e) == 2) & (F.size(F.get(e, 0)) == 2) & (F.size(F.get(e, 1)) == 2)
    correct = F.col("exec.correct") & F.coalesce(e_shape, F.lit(False))
    status = (F.when(~F.col("readable"), "bad_matrix").when(F.col("empty"), "empty")
              .when(~F.col("valid") | ~F.coalesce(F.col("exec.ok"), F.lit(False)), "failed")
              .when(correct, "correct").otherwise("incorrect"))
    df = df.withColumn("status", status)
    return df.withColumn("reward", reward_expr(F.col("status"), F.col("n_mults"), F.col("tag_bonus"), version)) \
             .withColumn("correct", F.col("status") == "correct")


# ---- group statistics ----------------------------------------------------------------

def status_tally(scored: DataFrame) -> DataFrame:
    """Completions per status."""
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


STATUSES = ("correct", "incorrect", "failed", "empty", "bad_matrix")


def score_metrics() -> list[Column]:
    """A4, A5, A14 as metrics to observe on scored rows: rows per status, rows, sum of rewards, best count."""
    return [*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("n"),
            F.sum("reward").alias("total_reward"), F.min(F.when(F.col("correct"), F.col("n_mults"))).alias("best_n_mults")]


def observed(scored: DataFrame, name: str = "scores") -> DataFrame:
    """``scored`` with its metrics observed under ``name``: a stream reports them in the progress of each micro-batch."""
    return scored.observe(name, *score_metrics())


def write_observed(scored: DataFrame, path: str) -> dict:
    """Write scored rows and return the metrics of ``score_metrics`` (and ``mean_reward``), gathered by the same pass.

    Spark counts the rows of every task that ends well, so a task that runs again because its output was lost
    counts twice; over rows read back from ``path``, the aggregates themselves are exact."""
    seen = Observation("scores")
    scored.observe(seen, *score_metrics()).write.mode("overwrite").parquet(path)
    found = dict(seen.get)
    return found | {"mean_reward": found["total_reward"] / found["n"] if found["n"] else None}


def call_ordinals(keys: DataFrame, prompts_per_call: int = 4, key: str = "prompt_id") -> DataFrame:
    """(key, call): which reward call scores a prompt, the prompts in key order,
    ``prompts_per_call`` to a call.  Right for any keys, dense or not.

    Ordinals by a two-level count: prompts are dealt into key ranges, numbered
    inside each range, and the ranges' sizes are accumulated; no task sorts them all."""
    dealt = materialize(keys.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
                  .select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return (dealt.withColumn("inside", inside).join(sizes, F.col("part") == F.col("p"))
                 .select(key, F.floor((F.col("before") + F.col("inside")) / prompts_per_call).cast("bigint").alias("call")))


def with_call(df: DataFrame, prompts_per_call: int = 4) -> DataFrame:
    """The reward-call ordinal of each completion, joined on its prompt."""
    return df.join(call_ordinals(df, prompts_per_call), "prompt_id")


def batch_means(scored: DataFrame, prompts_per_call: int = 4) -> DataFrame:
    """A4: mean reward per call.  Prompts are reduced to sum and count first, so the
    completions are scored once and never joined."""
    per_prompt = materialize(scored.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total")))
    return (with_call(per_prompt, prompts_per_call).groupBy("call")
            .agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_reward")))


def full_batches(completions: DataFrame, prompts_per_call: int = 4, generations: int | None = None) -> DataFrame:
    """The calls that a trainer runs: those with a full set of prompts (and, if
    ``generations`` is given, that many completions of each); others are dropped."""
    per_prompt = materialize(completions.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n")))
    calls = (with_call(per_prompt, prompts_per_call).groupBy("call")
             .agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_completions"),
                  F.min("n").alias("least"), F.max("n").alias("most")))
    full = F.col("n_prompts") == prompts_per_call
    if generations is not None:
        full = full & (F.col("least") == generations) & (F.col("most") == generations)
    return calls.filter(full).drop("least", "most")


def best_script(scored: DataFrame) -> DataFrame:
    """A5 + T-5: fewest multiplications among correct completions and the
    first script reaching it (by prompt, then generation)."""
    # conditional aggregation, not a filter: a filter on a derived column is
    # pushed below the projections and would re-evaluate the scoring folds
    ok = F.col("correct")
    return scored.agg(F.min(F.when(ok, F.col("n_mults"))).alias("best_n_mults"),
                      F.min_by(F.col("script"), F.when(ok, F.struct("n_mults", "prompt_id", "gen_idx")))
                      .alias("best_script"),
                      F.count_if(ok).alias("n_correct"))


def advantages(scored: DataFrame, scale: bool = True, eps: float = ADV_EPS, cut: bool = True) -> DataFrame:
    """Group-relative advantage per prompt: reward minus the prompt's
    mean, divided by its sample std + eps when ``scale``.  Group stats are a
    grouped aggregate joined back on the key (skew-safe); the input is
    checkpointed first (``cut``) so it is computed once."""
    if cut:
        scored = materialize(scored)
    g = (scored.groupBy("prompt_id")
         .agg(F.avg("reward").alias("group_mean"), F.stddev_samp("reward").alias("group_std"),
              F.count(F.lit(1)).alias("group_size")))
    df = scored.join(g, "prompt_id")
    adv = F.col("reward") - F.col("group_mean")
    if scale:
        adv = adv / (F.coalesce(F.col("group_std"), F.lit(0.0)) + F.lit(eps))
    return df.withColumn("advantage", adv)


def pass_at_k_expr(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k = 1 - C(n-c, k) / C(n, k), as a stable product
    1 - prod_{i=n-c+1..n} (1 - k/i); NULL when n < k."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i.cast("double")))
    # c = 0 must short-circuit: sequence(n+1, n) would count down, not be empty
    return (F.when(n < k, F.lit(None).cast("double"))
            .when(c == 0, F.lit(0.0))
            .when(n - c < k, F.lit(1.0))
            .otherwise(F.lit(1.0) - prod))


def pass_at_k(scored: DataFrame, ks=(1, 2, 4)) -> DataFrame:
    """Per-prompt pass@k, averaged over prompts with at least k samples."""
    per_prompt = (scored.groupBy("prompt_id")
                  .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("c")))
    cols = [pass_at_k_expr(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in ks]
    pp = per_prompt.select("prompt_id", *cols)
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in ks]
    long = pp.select(F.explode(F.array(*rows)).alias("x")).select("x.k", "x.p")
    return (long.where(F.col("p").isNotNull()).groupBy("k")
            .agg(F.count(F.lit(1)).alias("n_prompts"), F.avg("p").alias("pass_at_k")))


def improvements(correct: DataFrame, order: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """The strict improvements of n_mults in the order of ``order``: those columns, n_mults, ``carry``.

    Only the first row that reaches each count can be one (a grouped minimum, one row a count);
    a prefix scan over these finds those that beat all before."""
    first = F.min(F.struct(*order, *carry)).alias("e")
    firsts = correct.groupBy("n_mults").agg(first).select("e.*", "n_mults")
    found = prefix_scan(firsts, "min", "n_mults", order, "best_before", inclusive=False)
    return found.where(F.col("best_before").isNull() | (F.col("n_mults") < F.col("best_before"))).drop("best_before")


def running_best(scored: DataFrame, prompts_per_call: int = 4, cut: bool = True) -> DataFrame:
    """Best multiplication count among correct completions
    strictly before each row in (call, prompt_id, gen_idx) order, and whether
    the row is a strict improvement: a prefix scan over key ranges."""
    df = with_call(materialize(scored) if cut else scored, prompts_per_call)
    reached = F.when(F.col("correct"), F.col("n_mults"))
    df = prefix_scan(df, "min", reached, ["call", "prompt_id", "gen_idx"], "best_before", inclusive=False)
    is_event = F.col("correct") & (F.col("best_before").isNull() | (F.col("n_mults") < F.col("best_before")))
    return df.withColumn("is_event", F.coalesce(is_event, F.lit(False)))


def reward_sum(df: DataFrame, columns: list[str], out: str = "total_reward") -> DataFrame:
    """Several reward functions, weight 1 each."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return df.withColumn(out, total)


def with_content(df: DataFrame, messages: str) -> DataFrame:
    """rows whose (first) message has content; rows are keyed, so nothing shifts."""
    return df.where(F.get(F.col(messages), 0)["content"].isNotNull())


def truncation_mask(df: DataFrame, n_tokens: str, limit: int, col_in: str = "advantage",
                    out: str = "masked_advantage") -> DataFrame:
    """completions that hit the length limit contribute nothing."""
    return df.withColumn(out, F.when(F.col(n_tokens) >= limit, F.lit(0.0)).otherwise(F.col(col_in)))


# ---- Q2: reward functions by name ---------------------------------------------------
# A reward takes a completions-with-context DataFrame and the name of its output
# column, and returns the DataFrame with that column; ``apply_rewards`` adds rewards and
# their weight-1 sum (A11).  Script rewards read the context column ``prompts`` is joined on.

Reward = Callable[[DataFrame, str], DataFrame]


def _format_reward(df: DataFrame, out: str) -> DataFrame:
    from quadrant.operators.evaluate import format_reward
    return df.withColumn(out, format_reward("completion"))


def _accuracy_reward(df: DataFrame, out: str) -> DataFrame:
    from quadrant.operators.evaluate import accuracy_reward
    return df.withColumn(out, accuracy_reward("completion", "solution"))


def script_reward(version: int) -> Reward:
    """R3 / R4 as a reward: the rows carry the prompt's matrix strings themselves."""
    def reward(df: DataFrame, out: str) -> DataFrame:
        held = df.withColumn("_row", F.struct(*df.columns))
        block = extract_script(held.select("_row", "completion", "A_matrix_str", "B_matrix_str", "expected_C_str"),
                               "completion", version)
        done = score_rows(matrices_from_strings(block), version)
        return done.select("_row.*", F.col("reward").alias(out))
    return reward


REWARD_FUNCTIONS: dict[str, Reward] = {"format": _format_reward, "accuracy": _accuracy_reward,
                                       "script_v1": script_reward(1), "script_v2": script_reward(2)}


def register_reward(name: str, reward: Reward) -> None:
    """A user's reward under a name of their own."""
    REWARD_FUNCTIONS[name] = reward


def apply_rewards(df: DataFrame, names: list[str], out: str = "total_reward") -> DataFrame:
    for n in names:
        df = REWARD_FUNCTIONS[n](df, f"reward_{n}")
    return reward_sum(df, [f"reward_{n}" for n in names], out)
