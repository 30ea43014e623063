"""DuckDB SQL oracles, one per query in :mod:`quadrant.plans.catalog`.

Inputs are derived from the driver views with the same derivation text as the
Spark side (:mod:`quadrant.sources.derive`); the operators (extraction,
parsing, compiling, evaluation, scoring, statistics) are written separately
in DuckDB SQL (:mod:`quadrant.plans.duck`)."""

from __future__ import annotations

import json

from quadrant.operators import evaluate as ev
from quadrant.operators import score as sc
from quadrant.plans import catalog as cat
from quadrant.plans import duck as Q
from quadrant.sources import derive as dv
from quadrant.sources import tables as tb
from quadrant.sources.sqlgen import DUCK, nest_stages


def r6(x, n: int = 6) -> str:
    return f"round({x}, {n})"


def product(a: str, b: str) -> str:
    def cell(r, c):
        return f"({a}[{r}][1] * {b}[1][{c}] + {a}[{r}][2] * {b}[2][{c}])"
    return f"[[{cell(1, 1)}, {cell(1, 2)}], [{cell(2, 1)}, {cell(2, 2)}]]"


def compact(m: str) -> str:
    return f"CAST(to_json({m}) AS VARCHAR)"


def pyrepr(m: str) -> str:
    return f"replace({compact(m)}, ',', ', ')"


def mix(key: str, slot: int) -> str:
    return DUCK.mix(key, str(slot))


# ---- input CTEs --------------------------------------------------------------------------

def prompts_cte() -> str:
    a, b = dv.prompt_matrices(DUCK, "o_orderkey")
    return f"""q_p0 AS (SELECT o_orderkey AS prompt_id, {a} AS A, {b} AS B FROM orders),
q_prompts AS (SELECT prompt_id, A, B, {product('A', 'B')} AS C,
  'Given matrices A = ' || {compact('A')} || ' and B = ' || {compact('B')} || ', what is the resulting matrix C = A * B?' AS user_query,
  {pyrepr('A')} AS A_matrix_str, {pyrepr('B')} AS B_matrix_str, {pyrepr(product('A', 'B'))} AS expected_C_str
  FROM q_p0)"""


def completions_cte() -> str:
    src = ("(SELECT l_orderkey AS prompt_id, CAST(l_linenumber - 1 AS INTEGER) AS gen_idx, "
           "l_orderkey * 8 + l_linenumber AS _key, l_partkey FROM lineitem)")
    body = nest_stages(src, dv.completion_stages(DUCK, "_key", "l_partkey"))
    return f"q_completions AS MATERIALIZED (SELECT prompt_id, gen_idx, completion FROM {body})"


def scripts_cte() -> str:
    return f"q_scripts AS MATERIALIZED (SELECT *, {Q.script_from_completion('completion')} AS script FROM q_completions)"


def valid_2x2(m: str) -> str:
    x, row = Q.var(), Q.var()
    return (f"coalesce(len({m}) = 2 AND len({m}[1]) = 2 AND len({m}[2]) >= 2 AND "
            f"list_bool_and(list_transform({m}, lambda {row}: list_bool_and(list_transform({row}, lambda {x}: {x} IS NOT NULL)))), false)")


def product_ok(m: str) -> str:
    return f"coalesce(len({m}) >= 2 AND len({m}[1]) >= 2 AND len({m}[2]) >= 2, false)"


def scored_ctes(version: int) -> str:
    dialect = "E1" if version == 1 else "E2"
    bonus = "CASE WHEN tagged THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    if version == 2:
        bonus = f"CASE WHEN script = '' THEN 0.0::DOUBLE ELSE {bonus} END"
    stages = Q.execute_cols("prog", "A", "B", "E", doubles=("Ad", "Bd", "Ed"), floating="(A IS NULL OR B IS NULL OR E IS NULL)")
    execd = nest_stages("q_s2b", stages)
    n = "CAST(n_mults AS DOUBLE)"
    if version == 1:
        right, wrong = f"{n} * -1.0::DOUBLE + tag_bonus", "-100.0::DOUBLE + tag_bonus"
    else:
        shaping = f"(-0.1::DOUBLE * {n})"
        right = f"({n} * -1.0::DOUBLE + {shaping}) + tag_bonus"
        wrong = f"(-100.0::DOUBLE + ({n} * -1.0::DOUBLE + {shaping})) + tag_bonus"
    e_shape = "coalesce(len(Ed) = 2 AND len(Ed[1]) = 2 AND len(Ed[2]) = 2, false)"
    a_str = f"CASE WHEN {mix('prompt_id', 700)} % 9 = 0 THEN regexp_replace(A_matrix_str, '([0-9]+)', '\\1.0', 'g') ELSE A_matrix_str END"
    decoded = ", ".join(f"CASE WHEN NOT contains({t}, '.') THEN TRY_CAST({t} AS BIGINT[][]) END AS {m}, TRY_CAST({t} AS DOUBLE[][]) AS {m}d"
                        for m, t in (("A", "a_str"), ("B", "B_matrix_str"), ("E", "expected_C_str")))
    return f"""{prompts_cte()},
{completions_cte()},
q_s0 AS (SELECT c.prompt_id, c.gen_idx, c.completion, {decoded}
   FROM q_completions c LEFT JOIN (SELECT *, {a_str} AS a_str FROM q_prompts) p USING (prompt_id)),
q_s1 AS (SELECT *, {Q.rx('completion', Q.TAG_RE)} AS tagged, {Q.script_from_completion('completion')} AS script FROM q_s0),
q_s1b AS (SELECT *, {bonus} AS tag_bonus, {Q.is_sentinel('script')} AS empty,
   (Ad IS NOT NULL AND Bd IS NOT NULL AND Ed IS NOT NULL) AS readable, ({valid_2x2('Ad')} AND {valid_2x2('Bd')}) AS valid FROM q_s1),
q_s2 AS MATERIALIZED (SELECT *, CASE WHEN readable AND NOT empty AND valid THEN script END AS run_script FROM q_s1b),
{Q.compiled('q_s2', 'run_script', dialect, {'n': Q.count_by_pattern('d.script')})},
q_s2b AS MATERIALIZED (SELECT x.*, g.prog, coalesce(g.n, 0) AS n_mults FROM q_s2 x LEFT JOIN q_progs g ON x.run_script = g.script),
q_s3 AS MATERIALIZED (SELECT *,
   CASE WHEN NOT readable THEN 'bad_matrix' WHEN empty THEN 'empty'
        WHEN NOT valid OR NOT coalesce(exec_ok, false) THEN 'failed'
        WHEN exec_correct AND {e_shape} THEN 'correct' ELSE 'incorrect' END AS status
   FROM {execd}),
q_scored AS MATERIALIZED (SELECT *, CASE WHEN status = 'bad_matrix' THEN -100.0::DOUBLE + 0.1::DOUBLE
   WHEN status = 'correct' THEN {right} WHEN status = 'incorrect' THEN {wrong}
   ELSE -100.0::DOUBLE + tag_bonus END AS reward, status = 'correct' AS correct FROM q_s3)"""


def with_(ctes: str, select: str) -> str:
    """``WITH ctes select``; ``select`` may start with further CTEs."""
    sep = "\n" if select.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH {ctes}{sep}{select}"


# ---- oracles -------------------------------------------------------------------------------

def o_x1_clean_text() -> str:
    return f"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
  CAST(len({Q.clean_lines('text')}) AS BIGINT) AS n_clean,
  CAST(len({Q.clean_lines('text', True)}) AS BIGINT) AS n_code,
  CAST(length(clean) AS BIGINT) AS clean_len, sha256(clean) AS clean_sha256,
  CAST({Q.count_stars('text')} AS BIGINT) AS stars
FROM (SELECT doc_id, text, array_to_string({Q.clean_lines(Q.remove_tokens('text'))}, chr(10)) AS clean FROM documents)"""


def o_f5_tag_extract() -> str:
    body = Q.strip(f"regexp_extract(completion, {Q.q(Q.TAG_RE)}, 1)")
    return with_(f"{completions_cte()},\n{scripts_cte()}", f"""SELECT prompt_id, gen_idx,
  {Q.rx('completion', Q.TAG_RE)} AS tagged, CAST(length({body}) AS BIGINT) AS body_len, sha256({body}) AS body_sha256,
  CAST(length(script) AS BIGINT) AS script_len, sha256(script) AS script_sha256, CAST(len({Q.clean_lines('script')}) AS BIGINT) AS n_lines,
  {Q.is_sentinel('script')} AS empty FROM q_scripts""")


def o_r1_reply_extract() -> str:
    mark = "'<|im_start|>assistant'"
    prompt = f"('<|im_start|>user' || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10) || {mark} || chr(10))"
    v = f"({mix('a.conv_id * 16 + a.turn', 500)} % 5)"
    full = (f"CASE WHEN {v} = 0 THEN {prompt} || a.text || '<|im_end|>' "
            f"WHEN {v} = 1 THEN 'preamble ' || {prompt} || a.text || '<|endoftext|>' "
            f"WHEN {v} = 2 THEN a.text WHEN {v} = 3 THEN {prompt} || a.text || '<|im_end|><|endoftext|>' "
            f"ELSE 'preamble ' || {prompt} || a.text || {mark} END")
    # the text behind the last marker: what is left when cut at every marker
    last = f"string_split(_full, {mark})[-1]"
    reply = (f"CASE WHEN starts_with(_full, _prompt) THEN {Q.strip('substring(_full, length(_prompt) + 1)')} "
             f"WHEN contains(_full, {mark}) AND contains({last}, chr(10)) "
             f"THEN {Q.strip(f'substring({last}, instr({last}, chr(10)) + 1)')} ELSE _full END")
    cut1 = f"CASE WHEN ends_with(r0, '<|im_end|>') THEN {Q.strip('left(r0, length(r0) - 10)')} ELSE r0 END"
    cut2 = f"CASE WHEN ends_with(r1, '<|endoftext|>') THEN {Q.strip('left(r1, length(r1) - 13)')} ELSE r1 END"
    return f"""WITH x AS (SELECT a.conv_id, a.turn, {prompt} AS _prompt, {full} AS _full
  FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn + 1 = a.turn WHERE a.role = 'assistant'),
y AS (SELECT conv_id, turn, {reply} AS r0 FROM x),
z AS (SELECT conv_id, turn, {cut1} AS r1 FROM y)
SELECT conv_id, turn, {cut2} AS reply FROM z"""


def o_g1_matrix_pairs() -> str:
    return with_(prompts_cte(), "SELECT prompt_id, user_query, A_matrix_str, B_matrix_str, expected_C_str FROM q_prompts")


def raw_cte() -> str:
    v = f"({mix('prompt_id', 300)} % 6)"
    return f"""q_raw AS (SELECT prompt_id,
  CASE WHEN {v} <> 4 THEN user_query END AS user_query,
  CASE WHEN {v} = 0 THEN A END AS matrix_A_list, CASE WHEN {v} = 0 THEN B END AS matrix_B_list,
  CASE WHEN {v} = 1 THEN A_matrix_str WHEN {v} = 2 THEN 'nope' WHEN {v} = 3 THEN '[[1, 2]]'
       WHEN {v} = 5 THEN regexp_replace(A_matrix_str, '^\\[\\[(-?[0-9]+)', '[[\\1.50') END AS A_matrix_str,
  CASE WHEN {v} <> 0 THEN B_matrix_str END AS B_matrix_str FROM q_prompts)"""


def o_p1_prepare_prompts() -> str:
    """Cells stay text here, as a Python literal would print."""
    lists_ok = "(matrix_A_list IS NOT NULL AND matrix_B_list IS NOT NULL)"

    def cells(x):
        row, c = Q.var(), Q.var()
        return (f"list_transform({x}, lambda {row}: list_transform({row}, lambda {c}: "
                f"CASE WHEN contains({c}, '.') THEN CAST(CAST({c} AS DOUBLE) AS VARCHAR) ELSE {c} END))")

    def from_text(s):
        return (f"CASE WHEN {s} IS NOT NULL THEN CASE WHEN TRY_CAST({s} AS DOUBLE[][]) IS NULL THEN [['0','0'],['0','0']] "
                f"ELSE {cells(f'CAST({s} AS VARCHAR[][])')} END END")

    def cell(r, c):
        xs = [f"_A[{r}][1]", f"_B[1][{c}]", f"_A[{r}][2]", f"_B[2][{c}]"]
        f = [f"CAST({x} AS DOUBLE)" for x in xs]
        i = [f"TRY_CAST({x} AS BIGINT)" for x in xs]
        return (f"CASE WHEN {' OR '.join(f'contains({x}, chr(46))' for x in xs)} THEN CAST({f[0]} * {f[1]} + {f[2]} * {f[3]} AS VARCHAR) "
                f"ELSE CAST({i[0]} * {i[1]} + {i[2]} * {i[3]} AS VARCHAR) END")

    def shown(m):
        row = Q.var()
        return f"'[' || array_to_string(list_transform({m}, lambda {row}: '[' || array_to_string({row}, ', ') || ']'), ', ') || ']'"
    ones, zeros = "[['1','1'],['1','1']]", "[['0','0'],['0','0']]"
    return with_(f"{prompts_cte()},\n{raw_cte()}", f"""a AS (SELECT prompt_id, user_query,
  CASE WHEN {lists_ok} THEN CAST(matrix_A_list AS VARCHAR[][]) ELSE {from_text('A_matrix_str')} END AS _a,
  CASE WHEN {lists_ok} THEN CAST(matrix_B_list AS VARCHAR[][]) ELSE {from_text('B_matrix_str')} END AS _b FROM q_raw),
b AS (SELECT prompt_id, user_query,
  CASE WHEN _a IS NOT NULL AND _b IS NOT NULL THEN _a ELSE {ones} END AS _A,
  CASE WHEN _a IS NOT NULL AND _b IS NOT NULL THEN _b ELSE {ones} END AS _B FROM a),
c AS (SELECT *, CASE WHEN {product_ok('_A')} AND {product_ok('_B')} THEN [[{cell(1, 1)}, {cell(1, 2)}], [{cell(2, 1)}, {cell(2, 2)}]] ELSE {zeros} END AS _C,
  coalesce(user_query, {Q.q(tb.DEFAULT_USER_PROMPT)}) AS user_content FROM b)
SELECT prompt_id, {shown('_A')} AS A_matrix_str, {shown('_B')} AS B_matrix_str, {shown('_C')} AS expected_C_str,
  user_content, CAST(length({Q.q(tb.SYSTEM_MESSAGE)}) + length(user_content) AS BIGINT) AS prompt_chars,
  sha256('system' || chr(10) || {Q.q(tb.SYSTEM_MESSAGE)} || chr(10) || 'user' || chr(10) || user_content) AS prompt_sha256 FROM c""")


def o_f4_valid_matrices() -> str:
    a = "coalesce(CAST(matrix_A_list AS DOUBLE[][]), TRY_CAST(A_matrix_str AS DOUBLE[][]))"
    return with_(f"{prompts_cte()},\n{raw_cte()}",
                 f"SELECT prompt_id, {valid_2x2(a)} AS a_valid, {product_ok(a)} AS a_product_ok FROM q_raw")


def o_r10_parse_matrices() -> str:
    v = f"({mix('prompt_id', 600)} % 3)"
    text = (f"CASE WHEN {v} = 0 THEN 'Multiply ' || {compact('A')} || ' by ' || {compact('B')} "
            f"WHEN {v} = 1 THEN 'A = ' || A_matrix_str || chr(10) || 'B = ' || B_matrix_str || ' please' "
            f"ELSE 'only ' || {compact('A')} END")
    from quadrant.functions.matrix import MATRIX_TEXT_RE
    found = f"regexp_extract_all(t, {Q.q(MATRIX_TEXT_RE)})"
    cols = []
    for mi, m in enumerate(("a", "b")):
        for k, rc in enumerate(("00", "01", "10", "11")):
            nums = f"regexp_extract_all(f[{mi + 1}], '-?\\d+(?:\\.\\d+)?')"
            default = f"CAST({'AB'[mi]}[{int(rc[0]) + 1}][{int(rc[1]) + 1}] AS DOUBLE)"
            cols.append(f"CASE WHEN len(f) >= 2 THEN CAST({nums}[{k + 1}] AS DOUBLE) ELSE {default} END AS {m}{rc}")
    return with_(prompts_cte(), f"""x AS (SELECT prompt_id, A, B, {text} AS t FROM q_prompts),
y AS (SELECT prompt_id, A, B, {found} AS f FROM x)
SELECT prompt_id, len(f) >= 2 AS found, {', '.join(cols)} FROM y""")


def counter_oracle(counter: str):
    def o():
        return with_(f"{completions_cte()},\n{scripts_cte()}",
                     f"SELECT prompt_id, gen_idx, CAST({Q.COUNTERS[counter]('script')} AS BIGINT) AS n FROM q_scripts")
    return o


def shown(k: int, expected: str) -> str:
    """A result cell; one that overflowed on the way to the right value has that value."""
    return f"coalesce(__cv[{k + 1}], CASE WHEN exec_correct THEN CAST(flatten({expected})[{k + 1}] AS BIGINT) END)"


def execute_oracle(dialect: str):
    def o():
        body = nest_stages("(SELECT s.prompt_id, s.gen_idx, g.prog, p.A, p.B, p.C FROM q_scripts s JOIN q_prompts p USING (prompt_id) "
                           "JOIN q_progs g ON s.script = g.script)", Q.execute_cols("prog", "A", "B", "C"))
        cells = ", ".join(f"CASE WHEN prog.ok AND NOT prog.has_float THEN {shown(k, 'C')} END AS c{rc}"
                          for k, rc in enumerate(("00", "01", "10", "11")))
        return with_(f"{prompts_cte()},\n{completions_cte()},\n{scripts_cte()},\n{Q.compiled('q_scripts', 'script', dialect)}",
                     f"SELECT prompt_id, gen_idx, prog.ok AS ok, prog.err AS err, prog.eline AS eline, {cells}, "
                     f"exec_correct AS correct FROM {body}")
    return o


def o_d1_script_dictionary() -> str:
    return with_(f"{completions_cte()},\n{scripts_cte()},\n{Q.compiled('q_scripts', 'script', 'E1', {'n': Q.count_by_pattern('d.script')})}",
                 "SELECT md5(script) AS script_hash, s.n AS n_rows, prog.ok AS ok, prog.err AS err, prog.eline AS eline, "
                 "CAST(g.n AS BIGINT) AS multiplications FROM q_progs g JOIN (SELECT script, count(*) AS n FROM q_scripts GROUP BY script) s USING (script)")


def o_d5_exact_results() -> str:
    """Residues of the results, folded modulo numbers that the Spark side does not compute with."""
    names = {"x1": cat.CHECK_PRIME, "x2": 10 ** 9}
    stages = [(f"__{x}", f"CASE WHEN prog.ok AND NOT prog.has_float THEN {Q.cells(Q.lane_values('prog', 'A', 'B', Q.residue_lane(m)), 'prog')} END")
              for x, m in names.items()]
    body = nest_stages("(SELECT s.prompt_id, s.gen_idx, g.prog, p.A, p.B FROM q_scripts s JOIN q_prompts p USING (prompt_id) "
                       "JOIN q_progs g ON s.script = g.script)", stages)
    shown_cells = ", ".join(f"__{x}[{k + 1}] AS c{rc}_{m}" for k, rc in enumerate(("00", "01", "10", "11"))
                            for x, m in (("x1", "prime"), ("x2", "digits")))
    return with_(f"{prompts_cte()},\n{completions_cte()},\n{scripts_cte()},\n{Q.compiled('q_scripts', 'script', 'E1')}",
                 f"SELECT prompt_id, gen_idx, {shown_cells} FROM {body}")


def o_j4_script_cases() -> str:
    cases = ", ".join(f"({k}, {json.dumps(a)}::BIGINT[][], {json.dumps(b)}::BIGINT[][])" for k, (a, b) in enumerate(cat.SCRIPT_CASES))
    body = nest_stages(f"(SELECT g.script, g.prog, c.k, c.A, c.B, {product('c.A', 'c.B')} AS C FROM q_progs g, (VALUES {cases}) c(k, A, B))",
                       Q.execute_cols("prog", "A", "B", "C"))
    return with_(f"{completions_cte()},\n{scripts_cte()},\n{Q.compiled('q_scripts', 'script', 'E4')}",
                 f"""t AS MATERIALIZED (SELECT script, k, prog.ok AS ok, exec_correct AS correct FROM {body})
SELECT s.prompt_id, s.gen_idx, CAST(t.k AS BIGINT) AS case_id, coalesce(t.ok, false) AS ok, coalesce(t.correct, false) AS correct,
  CAST({Q.count_by_pattern('s.script')} AS BIGINT) AS multiplications FROM q_scripts s JOIN t ON s.script = t.script""")


def reward_oracle(version: int):
    def o():
        return with_(scored_ctes(version), f"SELECT prompt_id, gen_idx, status, CAST(n_mults AS BIGINT) AS n_mults, "
                                           f"{r6('reward')} AS reward FROM q_scored")
    return o


def o_a14_status_tally() -> str:
    return with_(scored_ctes(1), "SELECT status, count(*) AS n FROM q_scored GROUP BY status")


CALL = f"CAST((dense_rank() OVER (ORDER BY prompt_id) - 1) // {cat.PROMPTS_PER_CALL} AS BIGINT)"


def o_a4_batch_mean() -> str:
    return with_(scored_ctes(1), f"SELECT call, count(*) AS n, {r6('avg(reward)')} AS mean_reward "
                                 f"FROM (SELECT {CALL} AS call, reward FROM q_scored) GROUP BY call")


def o_a5_best_script() -> str:
    return with_(scored_ctes(2), "SELECT CAST(min(n_mults) AS BIGINT) AS best_n_mults, "
                                 "arg_min(script, (n_mults, prompt_id, gen_idx)) AS best_script, "
                                 "count(*) AS n_correct FROM q_scored WHERE correct")


def o_a12_advantage() -> str:
    return with_(scored_ctes(2), f"""g AS (SELECT prompt_id, avg(reward) AS group_mean, stddev_samp(reward) AS group_std FROM q_scored GROUP BY prompt_id)
SELECT s.prompt_id, s.gen_idx, {r6('s.reward')} AS reward, {r6('g.group_mean')} AS group_mean,
  ({r6(f'(s.reward - g.group_mean) / (coalesce(g.group_std, 0.0::DOUBLE) + {sc.ADV_EPS}::DOUBLE)', 4)} + 0.0::DOUBLE) AS advantage
FROM q_scored s JOIN g USING (prompt_id)""")


def o_a13_pass_at_k() -> str:
    parts = []
    for k in cat.PASS_KS:
        i, acc = Q.var(), Q.var()
        prod = f"list_reduce(list_concat([1.0::DOUBLE], list_transform(range(n - c + 1, n + 1), lambda {i}: 1.0::DOUBLE - {k}.0::DOUBLE / CAST({i} AS DOUBLE))), lambda {acc}, {i}x: {acc} * {i}x)"
        pk = f"CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {prod} END"
        parts.append(f"SELECT CAST({k} AS BIGINT) AS k, {pk} AS p FROM pp")
    union = " UNION ALL ".join(parts)
    return with_(scored_ctes(2), f"""pp AS (SELECT prompt_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(correct) AS BIGINT) AS c FROM q_scored GROUP BY prompt_id),
l AS ({union})
SELECT k, count(*) AS n_prompts, {r6('avg(p)', 9)} AS pass_at_k FROM l WHERE p IS NOT NULL GROUP BY k""")


def o_w1_running_best() -> str:
    return with_(scored_ctes(2), f"""w AS (SELECT prompt_id, gen_idx, {CALL} AS call,
  n_mults, correct FROM q_scored),
x AS (SELECT *, min(CASE WHEN correct THEN n_mults END) OVER (ORDER BY call, prompt_id, gen_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM w)
SELECT prompt_id, gen_idx, call, CAST(best_before AS BIGINT) AS best_before,
  coalesce(correct AND (best_before IS NULL OR n_mults < best_before), false) AS is_event FROM x""")


def o_z1_best_stream() -> str:
    return with_(scored_ctes(2), """x AS (SELECT prompt_id, gen_idx, n_mults, script, correct,
  min(CASE WHEN correct THEN n_mults END) OVER (ORDER BY prompt_id, gen_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM q_scored)
SELECT prompt_id, gen_idx, CAST(n_mults AS BIGINT) AS n_mults, script FROM x WHERE correct AND (before IS NULL OR n_mults < before)""")


def o_w5_full_batches() -> str:
    return (f"SELECT call, count(DISTINCT prompt_id) AS n_prompts, count(*) AS n_completions "
            f"FROM (SELECT prompt_id, {CALL} AS call FROM (SELECT l_orderkey * 5 + l_orderkey % 3 AS prompt_id FROM lineitem)) "
            f"GROUP BY call HAVING count(DISTINCT prompt_id) = {cat.PROMPTS_PER_CALL}")


FORMAT_RE = f"(?s)\\A<think>.*?</think>{Q.WS}*<answer>.*?</answer>\\n?\\z"


def o_a11_reward_sum() -> str:
    fmt = f"CASE WHEN {Q.rx('completion', FORMAT_RE)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return with_(scored_ctes(2), f"SELECT prompt_id, gen_idx, {r6(f'0.0::DOUBLE + reward + {fmt}')} AS total_reward FROM q_scored")


def o_p10_expand_generations() -> str:
    return with_(prompts_cte(), f"SELECT prompt_id, CAST(unnest(range(0, {cat.GENERATIONS})) AS INTEGER) AS gen_idx, "
                                f"CAST(length(user_query) AS BIGINT) AS query_len, sha256(user_query) AS query_sha256 FROM q_prompts")


def o_j6_lint() -> str:
    """Lint as joins over exploded statements (the Spark side folds in the row)."""
    t = Q.var()
    inputs = "[" + ", ".join(Q.q(n) for n in Q.INPUT_NAMES) + "]"
    outputs = "[" + ", ".join(Q.q(n) for n in Q.OUTPUT_NAMES) + "]"
    return with_(f"{completions_cte()},\n{scripts_cte()}", f"""{Q.compiled('q_scripts', 'script', 'E1')},
st AS (SELECT script, unnest(stmts) AS s FROM q_stmts),
ok AS (SELECT * FROM st WHERE s.err IS NULL AND NOT s.skip),
defs AS (SELECT script, s.t AS name, s.line AS def_line FROM ok
  UNION ALL SELECT script, unnest({inputs}) AS name, 0 AS def_line FROM q_dist),
atoms AS (SELECT script, s.line AS use_line,
  unnest(flatten(list_transform(s.terms, lambda {t}: list_concat({t}.f1, coalesce({t}.f2, []))))) AS a FROM ok),
uses AS (SELECT DISTINCT script, use_line, a.a AS name FROM atoms
  WHERE NOT {Q.rx('a.a', Q.INT_LIT_RE)} AND NOT {Q.rx('a.a', Q.FLOAT_LIT_RE)}),
asof_use AS (SELECT u.script, u.name, u.use_line, max(d.def_line) AS def_line FROM uses u
  LEFT JOIN defs d ON d.script = u.script AND d.name = u.name AND d.def_line < u.use_line GROUP BY 1, 2, 3),
nu AS (SELECT script, count(*) AS n_uses FROM uses GROUP BY 1),
nd AS (SELECT script, count(*) AS n_undefined, min(use_line) AS first_undefined_line FROM asof_use WHERE def_line IS NULL GROUP BY 1),
req AS (SELECT script, unnest({outputs}) AS name FROM q_dist),
miss AS (SELECT r.script, count(*) AS n_missing_cells FROM req r
  WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.script = r.script AND d.name = r.name) GROUP BY 1)
SELECT s.prompt_id, s.gen_idx, coalesce(nu.n_uses, 0) AS n_uses, coalesce(nd.n_undefined, 0) AS n_undefined,
  CAST(nd.first_undefined_line AS BIGINT) AS first_undefined_line, coalesce(miss.n_missing_cells, 0) AS n_missing_cells
FROM q_scripts s LEFT JOIN nu USING (script) LEFT JOIN nd USING (script) LEFT JOIN miss USING (script)""")


def o_j5_def_use() -> str:
    """The same reads and definitions, matched by DuckDB's own as-of join."""
    t = Q.var()
    inputs = "[" + ", ".join(Q.q(n) for n in Q.INPUT_NAMES) + "]"
    outputs = ", ".join(Q.q(n) for n in Q.OUTPUT_NAMES)
    return with_(f"{completions_cte()},\n{scripts_cte()}", f"""{Q.compiled('q_scripts', 'script', 'E1')},
ok AS (SELECT * FROM (SELECT script, unnest(stmts) AS s FROM q_stmts) WHERE s.err IS NULL AND NOT s.skip),
defs AS (SELECT script, s.t AS name, s.line AS def_line FROM ok
  UNION ALL SELECT script, unnest({inputs}) AS name, 0 AS def_line FROM q_dist),
uses AS (SELECT DISTINCT script, use_line, a.a AS name FROM (SELECT script, s.line AS use_line,
    unnest(flatten(list_transform(s.terms, lambda {t}: list_concat({t}.f1, coalesce({t}.f2, []))))) AS a FROM ok)
  WHERE NOT {Q.rx('a.a', Q.INT_LIT_RE)} AND NOT {Q.rx('a.a', Q.FLOAT_LIT_RE)}),
seen AS (SELECT u.script, u.use_line, d.def_line FROM uses u
  ASOF LEFT JOIN defs d ON d.script = u.script AND d.name = u.name AND d.def_line < u.use_line),
sums AS (SELECT script, count(*) AS n_uses, count_if(def_line IS NULL) AS n_undefined,
  min(CASE WHEN def_line IS NULL THEN use_line END) AS first_undefined_line,
  sum(use_line - def_line) AS sum_distance, max(use_line - def_line) AS max_distance FROM seen GROUP BY script),
cells AS (SELECT script, count(DISTINCT name) AS n FROM defs WHERE name IN ({outputs}) GROUP BY script)
SELECT s.prompt_id, s.gen_idx, coalesce(n_uses, 0)::BIGINT AS n_uses, coalesce(n_undefined, 0)::BIGINT AS n_undefined,
  first_undefined_line::BIGINT AS first_undefined_line, 4 - coalesce(cells.n, 0) AS n_missing_cells,
  coalesce(sum_distance, 0)::BIGINT AS sum_distance, max_distance::BIGINT AS max_distance
FROM q_scripts s LEFT JOIN sums USING (script) LEFT JOIN cells USING (script)""")


def verify_ctes(source: str, reply: str, a: str, b: str, expected: str, dialect: str, counter: str,
                drop_comments: bool, double_inputs: bool, failed: bool) -> str:
    """Verification over CTE ``source``; ``failed``: FAILED rows report false / 0, else nothing."""
    script = f"array_to_string({Q.clean_lines(reply, drop_comments)}, chr(10))"
    sentinel = "(_script = '')" if drop_comments else Q.is_sentinel("_script")
    body = nest_stages("q_v1b", Q.execute_cols("prog", a, b, expected, double_inputs=double_inputs))
    reason = (f"CASE WHEN {sentinel} THEN 'no valid script' WHEN NOT _valid THEN 'bad matrix' "
              f"WHEN NOT coalesce(exec_ok, false) THEN prog.err || coalesce(' on line ' || CAST(prog.eline AS VARCHAR), '') END")
    no, zero = ("false", "0") if failed else ("NULL", "NULL")
    cells = "__cd" if double_inputs else f"CASE WHEN NOT prog.has_float THEN [{', '.join(shown(k, expected) for k in range(4))}] END"
    return f"""q_v0 AS MATERIALIZED (SELECT *, {script} AS _script FROM {source}),
q_v1 AS MATERIALIZED (SELECT *, ({valid_2x2(a)} AND {valid_2x2(b)}) AS _valid,
  CASE WHEN NOT {sentinel} AND {valid_2x2(a)} AND {valid_2x2(b)} THEN _script END AS _run FROM q_v0),
{Q.compiled('q_v1', '_run', dialect, {'n': Q.COUNTERS[counter]('d.script')})},
q_v1b AS MATERIALIZED (SELECT x.*, g.prog, g.n FROM q_v1 x LEFT JOIN q_progs g ON x._run = g.script),
q_v2 AS MATERIALIZED (SELECT *, coalesce(exec_ok, false) AS _ok, {reason} AS reason, {cells} AS _cells FROM {body}),
q_verified2 AS MATERIALIZED (SELECT *, CASE WHEN _ok THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN _ok THEN coalesce(exec_correct, false) ELSE {no} END AS correct,
  CASE WHEN _ok THEN n ELSE {zero} END AS multiplications,
  CASE WHEN _ok THEN n <= {sc.EFFICIENT_MAX_MULTS} ELSE {no} END AS efficient,
  CASE WHEN _ok THEN _script END AS script FROM q_v2)"""


def record_cols(expected: str) -> str:
    """result and expected cells of a verification record."""
    return ", ".join([f"CASE WHEN _ok THEN _cells[{k + 1}] END AS r{rc}, CASE WHEN _ok THEN {expected}[{int(rc[0]) + 1}][{int(rc[1]) + 1}] END AS e{rc}"
                      for k, rc in enumerate(("00", "01", "10", "11"))])


def _v1_ctes(counter: str) -> str:
    return (f"{prompts_cte()},\n{completions_cte()},\n"
            f"q_src AS (SELECT c.prompt_id, c.gen_idx, c.completion, p.A, p.B, p.C FROM q_completions c JOIN q_prompts p USING (prompt_id)),\n"
            + verify_ctes("q_src", "completion", "A", "B", "C", "E1", counter, False, False, True))


def o_r7_verify_v1() -> str:
    return with_(_v1_ctes("pattern"), f"SELECT prompt_id, gen_idx, status, correct, efficient, "
                                      f"CAST(multiplications AS BIGINT) AS multiplications, script, {record_cols('C')} FROM q_verified2")


def o_r7b_verify_end() -> str:
    return with_(_v1_ctes("product_lines"), "SELECT prompt_id, gen_idx, CASE WHEN status = 'FAILED' THEN 'failed' "
                 "WHEN NOT correct THEN 'incorrect' WHEN efficient THEN 'efficient' ELSE 'suboptimal' END AS label, "
                 "CAST(multiplications AS BIGINT) AS multiplications FROM q_verified2")


def responses_ctes() -> str:
    a, b = dv.test_matrices(DUCK, "l_orderkey")
    src = (f"q_resp AS (SELECT l_orderkey AS test_id, CAST(l_linenumber AS INTEGER) AS attempt, p_brand AS model, "
           f"{a} AS A, {b} AS B, {dv.response_text(DUCK, 'l_orderkey * 8 + l_linenumber')} AS response "
           f"FROM lineitem JOIN part ON l_partkey = p_partkey),\n"
           f"q_resp2 AS (SELECT *, {product('A', 'B')} AS _expected FROM q_resp)")
    return src + ",\n" + verify_ctes("q_resp2", "response", "A", "B", "_expected", "E3", "stars", True, True, False)


def o_r8_verify_v2() -> str:
    return with_(responses_ctes(), f"SELECT test_id, attempt, model, status, reason, correct, efficient, "
                                   f"CAST(multiplications AS BIGINT) AS multiplications, script, {record_cols('_expected')} FROM q_verified2")


def rate_cols() -> str:
    def rate(c):
        return f"coalesce(CAST({c} AS DOUBLE) / nullif(total_tests, 0), 0.0)"
    return (f"total_tests, correct, efficient, {r6(rate('correct'))} AS accuracy, {r6(rate('efficient'))} AS efficiency_rate, "
            f"printf('%.1f%%', {rate('correct')} * 100) AS accuracy_pct, printf('%.1f%%', {rate('efficient')} * 100) AS efficiency_pct")


COUNTS = "count(*) AS total_tests, count_if(correct) AS correct, count_if(efficient) AS efficient"


def o_r9_batch_eval() -> str:
    return with_(responses_ctes(), f"""loaded AS (SELECT DISTINCT p_brand AS model FROM part WHERE NOT ends_with(p_brand, '5')
  UNION ALL SELECT 'untested'),
s AS (SELECT model, {COUNTS} FROM q_verified2 GROUP BY model),
t AS (SELECT model, coalesce(total_tests, 0) AS total_tests, coalesce(correct, 0) AS correct, coalesce(efficient, 0) AS efficient
  FROM loaded LEFT JOIN s USING (model))
SELECT model, {rate_cols()} FROM t""")


def o_r9_overall() -> str:
    return with_(responses_ctes(), f"s AS (SELECT {COUNTS} FROM q_verified2) SELECT {rate_cols()} FROM s")


def o_r7_summary() -> str:
    return with_(_v1_ctes("pattern"), f"s AS (SELECT {COUNTS} FROM q_verified2) SELECT {rate_cols()} FROM s")


def o_w2_entropy_ratio() -> str:
    def first(frag):
        e = Q.var()
        return f"list_filter(map_entries(logs), lambda {e}: instr(lower({e}.key), {Q.q(frag)}) > 0 AND {e}.value IS NOT NULL)[1].value"
    key = ("CASE WHEN event_type = 'view' THEN 'train/entropy' WHEN event_type = 'click' THEN 'train/kl' "
           "WHEN event_type = 'error' THEN 'train/advantage_mean' WHEN event_type = 'purchase' THEN 'train/reward' "
           "ELSE 'train/loss' END")
    return f"""WITH ml AS (SELECT 'run-' || CAST(user_id % 4 AS VARCHAR) AS run, event_id AS step,
  map(['old/entropy', {key}, 'train/learning_rate'], [NULL, value, 2e-6::DOUBLE]) AS logs FROM events),
m AS (SELECT run, step, {first(ev.ENTROPY_KEY)} AS entropy, {first(ev.KL_KEY)} AS kl, {first(ev.ADVANTAGE_KEY)} AS adv FROM ml),
b AS (SELECT run, arg_min(entropy, step) AS entropy0 FROM m WHERE entropy IS NOT NULL GROUP BY run)
SELECT run, step, {r6('entropy')} AS entropy, {r6('kl')} AS kl, {r6('adv')} AS adv,
  {r6(f'CASE WHEN entropy IS NOT NULL THEN 100.0::DOUBLE * entropy / (entropy0 + {ev.ENTROPY_EPS}::DOUBLE) END')} AS entropy_pct
FROM m LEFT JOIN b USING (run)"""



def o_w2_running_baseline() -> str:
    """A running window over each run's steps."""
    whole = o_w2_entropy_ratio()
    m = whole[:whole.index("b AS (SELECT run")].rstrip().rstrip(",")
    return f"""{m},
x AS (SELECT run, step, entropy, first_value(entropy IGNORE NULLS) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS e0 FROM m)
SELECT run, step, {r6('e0')} AS entropy0, {r6(f'100.0::DOUBLE * entropy / (e0 + {ev.ENTROPY_EPS}::DOUBLE)')} AS entropy_pct FROM x"""


def reasoning_cte() -> str:
    k = "(conv_id * 16 + turn)"
    n = "CAST((conv_id * 7 + turn) % 10 AS VARCHAR)"
    n2 = "CAST((conv_id * 7 + turn + 1) % 10 AS VARCHAR)"
    base = f"('<think>' || text || '</think><answer>' || {n} || '</answer>')"
    v = f"({mix(k, 400)} % 6)"
    content = (f"CASE WHEN {v} = 0 THEN {base} WHEN {v} = 1 THEN ' ' || {base} WHEN {v} = 2 THEN {base} || chr(10) "
               f"WHEN {v} = 3 THEN {base} || chr(13) || chr(10) WHEN {v} = 4 THEN '<think>' || text || '</think>' "
               f"ELSE '<think>' || text || '</think>' || chr(10) || '<answer>$' || {n} || '$</answer>' END")
    s = f"({mix(k, 401)} % 3)"
    solution = f"CASE WHEN {s} = 0 THEN '\\boxed{{' || {n} || '}}' WHEN {s} = 1 THEN '$' || {n2} || '$' ELSE 'answer ' || {n} END"
    return f"q_rt AS (SELECT conv_id, turn, {content} AS content, {solution} AS solution FROM conversations WHERE role = 'assistant')"


def o_r5_format_reward() -> str:
    return with_(reasoning_cte(), f"SELECT conv_id, turn, CASE WHEN {Q.rx('content', FORMAT_RE)} THEN 1.0::DOUBLE "
                                  f"ELSE 0.0::DOUBLE END AS format_reward FROM q_rt")


def o_r6_answer_reward() -> str:
    answer_re = "(?s)<answer>(.*?)</answer>"
    boxed, dollar = ev.BOXED_RE, ev.DOLLAR_RE

    def val(x):
        return (f"CASE WHEN {Q.rx(x, boxed)} THEN {Q.strip(f'regexp_extract({x}, {Q.q(boxed)}, 1)')} "
                f"WHEN {Q.rx(x, dollar)} THEN {Q.strip(f'regexp_extract({x}, {Q.q(dollar)}, 1)')} END")
    eq = ("CASE WHEN TRY_CAST(av AS DOUBLE) IS NOT NULL AND TRY_CAST(gv AS DOUBLE) IS NOT NULL "
          "THEN TRY_CAST(av AS DOUBLE) = TRY_CAST(gv AS DOUBLE) "
          "ELSE regexp_replace(av, '\\s+', '', 'g') = regexp_replace(gv, '\\s+', '', 'g') END")
    return with_(reasoning_cte(), f"""a AS (SELECT conv_id, turn, solution,
  CASE WHEN {Q.rx('content', answer_re)} THEN {Q.strip(f'regexp_extract(content, {Q.q(answer_re)}, 1)')} END AS answer FROM q_rt),
b AS (SELECT *, {val('answer')} AS av, {val('solution')} AS gv FROM a)
SELECT conv_id, turn, answer, CASE WHEN answer IS NULL THEN 0.0::DOUBLE
  WHEN gv IS NOT NULL AND av IS NOT NULL THEN CASE WHEN {eq} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN gv IS NULL AND av IS NULL THEN CASE WHEN answer = solution THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE 0.0::DOUBLE END AS accuracy_reward FROM b""")


def o_p9_chat_text() -> str:
    return f"""WITH s AS (SELECT conv_id, arg_min(text, turn) AS system_text FROM conversations WHERE role = 'system' GROUP BY conv_id),
u AS (SELECT c.conv_id, c.turn, coalesce(s.system_text, {Q.q(ev.REASONING_SYSTEM)}) AS sys, c.text
  FROM conversations c LEFT JOIN s USING (conv_id) WHERE c.role = 'user')
SELECT conv_id, turn, 'System: ' || sys || chr(10) || 'User: ' || text || chr(10) || 'Assistant: ' AS chat,
  sys || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS basic FROM u"""


def o_p8_inference_prompt() -> str:
    return with_(prompts_cte(), "SELECT prompt_id, user_query || ' (Using A=' || A_matrix_str || ', B=' || B_matrix_str || ')' AS using_prompt, "
                                "user_query || chr(10) || 'A = ' || A_matrix_str || chr(10) || 'B = ' || B_matrix_str AS lines_prompt FROM q_prompts")


def o_p11_normalize() -> str:
    v = f"({mix('conv_id * 16 + turn', 800)} % 4)"
    return f"""SELECT conv_id, turn, CASE WHEN {v} = 0 THEN text
  ELSE to_json([{{'role': role, 'content': text}}, {{'role': 'user', 'content': 'next'}}])::VARCHAR END AS completion,
  len(string_split(text, ' ')) >= {cat.MASK_LIMIT} AS truncated,
  CASE WHEN len(string_split(text, ' ')) >= {cat.MASK_LIMIT} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS masked
FROM conversations WHERE {v} < 2"""


def o_q2_user_rewards() -> str:
    fmt = f"CASE WHEN {Q.rx('content', FORMAT_RE)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    share = "CASE WHEN conv_id % 5 <> 0 THEN 1.0::DOUBLE / (conv_id % 5) END"
    return with_(reasoning_cte(), f"""SELECT conv_id, turn, {fmt} AS builtin, {fmt} AS reward_format, {r6(share)} AS reward_share,
  CASE WHEN conv_id % 5 = 0 THEN 'ZeroDivisionError: float division by zero' END AS error_share, {r6(f'{fmt} + coalesce({share}, 0.0::DOUBLE)')} AS total
FROM q_rt""")


def o_a14_observed() -> str:
    statuses = ", ".join(f"count_if(status = '{s}') AS {s}" for s in sc.STATUSES)
    return with_(scored_ctes(2), f"SELECT {statuses}, count(*) AS n, CAST(min(CASE WHEN correct THEN n_mults END) AS BIGINT) AS best_n_mults, "
                                 f"{r6('avg(reward)')} AS mean_reward FROM q_scored")


def o_a8_rollup() -> str:
    return with_(responses_ctes(), """SELECT model, status, GROUPING(model, status)::BIGINT AS level, count(*) AS n,
  count_if(coalesce(correct, false)) AS correct, count_if(coalesce(efficient, false)) AS efficient,
  CAST(sum(coalesce(multiplications, 0)) AS BIGINT) AS multiplications FROM q_verified2 GROUP BY ROLLUP (model, status)""")


def o_a10_reuse_sketch() -> str:
    return with_(f"{completions_cte()},\n{scripts_cte()}", """SELECT CAST(coalesce(gen_idx, -1) AS BIGINT) AS gen_idx, count(script) AS n,
  count(DISTINCT script) AS n_exact, true AS within FROM q_scripts GROUP BY ROLLUP (gen_idx)""")


def o_p11_mixed_shapes() -> str:
    k = f"({mix('conv_id * 16 + turn', 801)} % 10)"
    return f"""SELECT conv_id, turn, CASE WHEN {k} <= 3 THEN text WHEN {k} = 4 THEN to_json([role, role])::VARCHAR WHEN {k} = 5 THEN '[]'
  WHEN {k} = 6 THEN to_json({{'role': role}})::VARCHAR WHEN {k} = 7 THEN CAST(turn AS VARCHAR) WHEN {k} = 9 THEN '{{' || text END AS completion
FROM conversations"""


def o_r6_symbolic() -> str:
    """By construction: the solution's value is the answer's unless the offset was added."""
    return ("SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward "
            "FROM conversations WHERE role = 'assistant'")


def o_u1_remove_tokens() -> str:
    out = "completion"
    for t in ("<|im_end|>", "<|endoftext|>", "<|file_separator|>", "<DSL>"):
        out = f"replace({out}, {Q.q(t)}, '')"
    return with_(completions_cte(), f"SELECT prompt_id, gen_idx, CAST(length({out}) AS BIGINT) AS n_chars, sha256({out}) AS text_sha256 FROM q_completions")


def o_g6_program_corpus() -> str:
    body = nest_stages("(SELECT o_orderkey AS program_id FROM orders)", dv.program_stages(DUCK, "program_id"))
    return (f"SELECT program_id, {Q.q(tb.CORPUS_PROMPT)} AS prompt, "
            f"{dv.wrap_dsl(DUCK, dv.program_text(DUCK))} AS completion FROM {body}")


def oracles() -> dict[str, str]:
    fns = {
        "x1_clean_text": o_x1_clean_text,
        "f5_tag_extract": o_f5_tag_extract,
        "r1_reply_extract": o_r1_reply_extract,
        "g1_matrix_pairs": o_g1_matrix_pairs,
        "p1_prepare_prompts": o_p1_prepare_prompts,
        "f4_valid_matrices": o_f4_valid_matrices,
        "r10_parse_matrices": o_r10_parse_matrices,
        "a1_star_count": counter_oracle("stars"),
        "a2_mult_count": counter_oracle("pattern"),
        "a3_mult_lines": counter_oracle("product_lines"),
        "d5_execute_e1": execute_oracle("E1"),
        "d5_execute_e2": execute_oracle("E2"),
        "d5_execute_e3": execute_oracle("E3"),
        "d5_execute_e4": execute_oracle("E4"),
        "j5_def_use": o_j5_def_use,
        "j6_lint": o_j6_lint,
        "r3_reward_v1": reward_oracle(1),
        "r4_reward_v2": reward_oracle(2),
        "a14_status_tally": o_a14_status_tally,
        "a4_batch_mean": o_a4_batch_mean,
        "a5_best_script": o_a5_best_script,
        "a12_advantage": o_a12_advantage,
        "a13_pass_at_k": o_a13_pass_at_k,
        "w1_running_best": o_w1_running_best,
        "w5_full_batches": o_w5_full_batches,
        "a11_reward_sum": o_a11_reward_sum,
        "p10_expand_generations": o_p10_expand_generations,
        "r7_verify_v1": o_r7_verify_v1,
        "r7b_verify_end": o_r7b_verify_end,
        "r8_verify_v2": o_r8_verify_v2,
        "r9_batch_eval": o_r9_batch_eval,
        "w2_entropy_ratio": o_w2_entropy_ratio,
        "w2_running_baseline": o_w2_running_baseline,
        "z1_best_stream": o_z1_best_stream,
        "z2_metric_stream": o_w2_entropy_ratio,
        "r5_format_reward": o_r5_format_reward,
        "r6_answer_reward": o_r6_answer_reward,
        "p9_chat_text": o_p9_chat_text,
        "g6_program_corpus": o_g6_program_corpus,
        "d1_script_dictionary": o_d1_script_dictionary,
        "d5_exact_results": o_d5_exact_results,
        "j4_script_cases": o_j4_script_cases,
        "r7_summary": o_r7_summary,
        "r9_overall": o_r9_overall,
        "p8_inference_prompt": o_p8_inference_prompt,
        "p11_normalize": o_p11_normalize,
        "p11_mixed_shapes": o_p11_mixed_shapes,
        "r6_symbolic": o_r6_symbolic,
        "q2_user_rewards": o_q2_user_rewards,
        "a14_observed": o_a14_observed,
        "a8_rollup": o_a8_rollup,
        "a10_reuse_sketch": o_a10_reuse_sketch,
        "u1_remove_tokens": o_u1_remove_tokens,
    }
    return {k: f() for k, f in fns.items()}
