"""Scripts in Arrow batches: what the columns share, and values at the edges of BIGINT."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import golden as G
from quadrant.operators import dsl, evaluate, exact, steps


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_columns_move_no_rows(spark):
    """F1-F32: scripts were grouped and exploded again, and parsed by nested lambdas, at over a millisecond a row."""
    df = spark.createDataFrame([(0, G.STRASSEN, *G.M1)], "k int, script string, A array<array<bigint>>, B array<array<bigint>>, E array<array<bigint>>")
    run = dsl.execute(dsl.compile_shared(df, per_script_columns={"n": dsl.count_by_pattern}), "prog", "A", "B", "E")
    for made in (run, evaluate.lint(df, ["k"])):
        plan = plan_of(made)
        assert "Aggregate" not in plan and "Generate" not in plan and "lambda" not in plan


def test_filters_do_not_run_scripts_again(spark):
    df = spark.createDataFrame([(0, G.STRASSEN, *G.M1)], "k int, script string, A array<array<bigint>>, B array<array<bigint>>, E array<array<bigint>>")
    run = dsl.execute(dsl.compile_shared(df), "prog", "A", "B", "E")
    assert plan_of(run.where("exec.correct")).count("ArrowEvalPython") <= plan_of(run).count("ArrowEvalPython")
    assert run.where("exec.correct").count() == 1


def test_edges_of_bigint(spark):
    low, high = -2 ** 63, 2 ** 63 - 1
    head, tail = "C[0,0] = ", "\nC[0,1] = 0\nC[1,0] = 0\nC[1,1] = 0"
    cases = {f"{low} + 1": low + 1, f"{high} + 1": None, f"A[0,0] - {low}": None, f"A[0,0] + {high}": None,
             f"0 + {low}": low, f"A[1,1] * {high}": None, f"A[0,0] * {high}": high, f"A[1,0] - {high}": low + 4}
    rows = [(e, head + e + tail, [[1, 2], [3, 4]], [[5, 6], [7, 8]]) for e in cases]
    df = spark.createDataFrame(rows, "e string, script string, A array<array<bigint>>, B array<array<bigint>>")
    df = df.withColumn("prog", dsl.compile_script("script", "E1"))
    got = {r.e: r for r in exact.with_exact_results(dsl.execute(df, "prog", "A", "B")).collect()}
    for e, want in cases.items():
        assert got[e].exec.result[0][0] == want, e
        if want is not None:
            assert got[e].exact[0] == str(want)
    assert got[f"{high} + 1"].exact[0] == str(high + 1) and got[f"A[0,0] - {low}"].exact[0] == str(1 - low)


def test_null_rows_and_long_literals(spark):
    long = "9" * 5000  # beyond what int() reads and BIGINT holds: the run is in doubles
    rows = [(0, None, [[1, 2], [3, 4]]), (1, f"C[0,0] = {long}\nC[0,1] = 0\nC[1,0] = 0\nC[1,1] = 0", [[1, 2], [3, 4]]), (2, G.STRASSEN, None)]
    df = spark.createDataFrame(rows, "k int, script string, A array<array<bigint>>").withColumn("B", F.col("A"))
    got = {r.k: r for r in dsl.execute(dsl.compile_shared(df), "prog", "A", "B", "B").collect()}
    assert got[0].prog is None and got[0].exec is None
    assert got[1].prog.has_float and got[1].exec.result_double[0][0] == float("inf") and got[1].exec.correct is False
    assert got[2].exec.ok and got[2].exec.result == [[None, None], [None, None]] and got[2].exec.correct is False


def test_residues_of_long_texts(spark):
    numbers = [0, 7, -7, 10 ** 17, -10 ** 18 - 3, 10 ** 40 + 9, -(10 ** 900) + 1, 2 ** 63]
    df = spark.createDataFrame([(str(n),) for n in numbers], "t string")
    for p in (998_244_353, 10 ** 9, dsl.P1):
        assert [r[0] for r in df.select(dsl.digits_mod(F.col("t"), p)).collect()] == [n % p for n in numbers]
        assert [steps.as_residue(str(n), p) for n in numbers] == [n % p for n in numbers]
    assert steps.decimal_text(-(10 ** 9000) + 5) == "-" + "9" * 8999 + "5"


def test_scripts_run_in_one_column(spark):
    """Programs went from one Python worker through Spark to another; now a script's lines run as they are read."""
    texts = [G.STRASSEN, G.NAIVE8_STEPS, G.BUILTIN7, G.SPACED_E2, "C[0,0] = M9", "", None,
             "C[0,0] = 1.5\nC[0,1] = A[0,0] - -0\nC[1,0] = 2\nC[1,1] = 3", "M1 = A[0,0] * B[0,0] * 2\nC[0,0] = M1 - M1",
             "M1 = A[0,0] * B[0,0]\n" + "".join(f"M{k} = M{k - 1} * M{k - 1}\n" for k in range(2, 9))
             + "".join(f"C[{r},{c}] = M8 - M8 + A[0,0]\n" for r in (0, 1) for c in (0, 1))]
    rows = [(k, s, a, G.M1[1], G.M1[2], d) for k, s in enumerate(texts) for d in (False, True)
            for a in (G.M1[0], None, [[-2 ** 63, 2], [3, None]], [[2 ** 62, 2 ** 62], [5, 7]])]
    cell = "array<array<bigint>>"
    df = spark.createDataFrame(rows, f"k int, script string, A {cell}, B {cell}, E {cell}, d boolean")
    for dialect in dsl.DIALECTS:
        kw = {"expected": "E", "doubles": ("A", "B", "E"), "floating": F.col("d")}
        run = dsl.run_scripts(df, "script", dialect, counter="pattern", **kw)
        assert plan_of(run).count("ArrowEvalPython") + plan_of(run).count("<lambda>") < 2
        old = dsl.execute(dsl.compile_shared(df, "script", dialect, per_script_columns={"n_mults": dsl.count_by_pattern}), "prog", **kw)
        got = run.select("k", "A", "d", "exec.*")
        want = old.select("k", "A", "d", *[f"exec.{c}" for c in ("ok", "err", "eline", "result", "result_double", "correct", "lane")],
                          F.when(F.col("prog").isNotNull(), F.col("n_mults")).alias("n_mults"))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), dialect


def test_plain_lines_read_as_any_line(spark):
    """Lines of plain names take a short way, with the same result."""
    g = dsl.grammar()
    for line in ("M1 = A[0,0]", "M1 = A[0,0] * B[0,0]", "S1 = M1 - M2", "C[0,0] = M1 + M2 - M3", "M1 = T1 * M2 + U1 * B[1,1]",
                 "M1 = T1 * T2 * T3", "M1 = T1 - T2 * T3 * T4", "M1 = M1 + M1 + M1"):
        for dialect in dsl.DIALECTS:
            assert g.plain.fullmatch(line)
            target, terms, err, skip, _, _ = g.parse_line(line, dialect)
            assert (target, terms, err) == g.parse_any(line, dialect) and not skip, (line, dialect)


def test_overflows_need_no_compiled_program():
    """A script of which a value overflowed was compiled, and run three times over by interpreted operations."""
    g = steps.Grammar(dsl)
    low = -2 ** 63
    cells = "".join(f"\nC[{r},{c}] = {x}" for (r, c), x in zip(((0, 0), (0, 1), (1, 0), (1, 1)), ("M8 - M8", "A[0,0]", "M2 + T1", "M8 - M2 - T1")))
    scripts = ["M1 = A[0,0] * B[0,0]\nT1 = A[0,1]\n" + "\n".join(f"M{k} = {x}" for k in range(2, 9)) + cells for x in (
        "M1 * M1", "M1 * M1 + T1 * M1", "(M1 - T1) * (M1 + T1)", "M1 - T1 - M1", "M1 + T1", "3 * M1", "M1 + -9223372036854775808", "M1 * T1;")]
    scripts += ["m8 = A[0,0] * B[0,0]\nM1 = m8\nM2 = M1 * B[0, 0]\nT1 = M2 * M2\nT1 = A[0,0]" + cells, "M1 = A[0,0] * B[0,0]\nM2 = M1 * M1\nM3 = M2 + x" + cells,
                "M1 = A[0,0] * B[0,0]\nM2 = M1 * M1\nM3 = M2 +", "M1 = A[0,0] * B[0,0]\nM2 = M1 * M1"]
    inputs = [[2 ** 40, 3, 5, 7, 2 ** 22, 1, 1, 1], [low + 1, low + 1, 1, 1, 1, 1, 1, 1], [2 ** 62, low + 2, 0, 0, 2, 2, 2, 2]]
    want = []
    for script in scripts:
        for dialect in dsl.DIALECTS:
            err, eline, code, literals, out, floats, _ = g.compile(script, dialect)
            for x in inputs:
                cells = (None,) * 4 if err else steps.output_cells(code, literals, out, x, [float(v) for v in x], floats, dsl.P1, dsl.P2)
                want.append((script, dialect, x, (err, eline, floats, *cells)))
    assert {d for _, d, _, found in want if found[5] is not None} >= {"E1", "E2"}  # residues were needed

    def never(*args):
        raise AssertionError("compiled")
    g.program = never
    for script, dialect, x, found in want:
        assert g.run(script, dialect, x, [float(v) for v in x], False, dsl.P1, dsl.P2) == found, (script, dialect, x)


def test_lint_reads_plain_lines_as_words():
    """every line of different names was parsed by patterns; lines of plain names fill nothing and give what parsing gives."""
    g = steps.Grammar(dsl)
    lines = ["M1 = A[0,0]", "M2 = M1 * M1", "M3 = M2 + U1", "S1 = M1 - M2 + M3", "S2 = X1 * A[0,0] + M1 * M2", "S3 = M1 * M2 * M3", "C[0,0] = U1 - U2",
             "S4 = M1 + M2 * M2 - M1 * A[0,0]", "M9 = M9 - M1;", "S5 = M1 / M2", "S6 = M1 ** M2", "C[0,1] = X1 + X1"]
    odd = ["m1 = A[0, 0]", "M1 * M2 = A[0,0]", "2 = M1", "M4 = (A[0,0] + U1) * M1", "M5 = 2 * M1", "C[1,0] M1", " = M1", "M6 = M1 * M2;;"]
    for dialect in dsl.DIALECTS:
        for script in ["\n".join(lines), "\n".join(lines[::-1]), *[f"{x}\n" + "\n".join(lines) for x in odd], "\n".join(odd + lines + odd)]:
            known, uses, undefined, first = set(g.inputs), 0, 0, None
            for number, target, _, err, names in g.statements(script, dialect):
                if err is None:
                    unknown = set(names) - known
                    uses, undefined = uses + len(names), undefined + len(unknown)
                    first = number if unknown and first is None else first
                    known.add(target)
            assert g.lint(script, dialect) == (uses, undefined, first, len(set(g.outputs) - known)), (script, dialect)
    g.kept_line.cache_clear()
    g.lint("\n".join(lines[:5]), "E1")
    assert g.kept_line.cache_info().misses == 0


def test_cases_move_no_rows(spark):
    """programs left the worker, were multiplied by the cases and came back, at 290 us of a core a script."""
    df = spark.createDataFrame([(0, G.STRASSEN)], "k int, script string")
    plan = plan_of(evaluate.script_cases(df, [G.M1[:2], G.M2[:2]]))
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Generate") < plan.index("ArrowEvalPython")


def test_cases_equal_compiled_programs(monkeypatch):
    """Scripts over cases, side by side, against each one compiled and run: words in every order, literals, overflows, long and odd texts."""
    rng, g = random.Random(11), dsl.grammar()
    names = [*g.inputs, "M1", "M2", "M3", "T", "2", "0.5", "a + b", "m1", "A[0, 0]", "C[0,0]"]

    def line(target):
        words = [rng.choice(names[:rng.choice([8, 11, len(names)])])]
        for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3, 3, 4])):
            words += [rng.choice("+-*"), rng.choice(names[:rng.choice([8, 11, len(names)])])]
        return f"{target} = {rng.choice([' ', ' ', ' ', '  ', '']).join(words)}{rng.choice([''] * 9 + [';', ' x', ' -'])}"
    good = ["M1 = A[0,0]", "M2 = B[0,0] + A[0,1]", "M3 = M1 * M2"]
    scripts = ["\n".join([*good[:rng.choice([0, 3, 3, 3])], *[line(rng.choice(["M1", "M2", "M3", "T", "a + b"])) for _ in range(rng.randrange(3))],
                          *[rng.choice([line(c), f"{c} = M1 * M2", f"{c} = M1 * M2 + M3 * M1", f"{c} = M1 - M2 - M3"]) for c in g.outputs]]) for _ in range(1500)]
    cell = "\n".join(f"{c} = X - X" for c in g.outputs)
    scripts += [None, "", "no script", G.STRASSEN, "X = A[0,0]\n" + "X = X * X\n" * 70 + cell, "M1 = B[1,1] * B[1,1]\n" + "M1 = M1 * M1\n" * 9 + cell.replace("X", "M1"),
                "M1 = \u00c4", "# " + "x" * 5000, G.NAIVE8_INLINE, f"C[0,0] = {2 ** 63}\n" + cell.replace("X", "A[0,0]"), f"M1 = -{2 ** 63}\n" + cell.replace("X", "M1")]
    pairs = [([1, 2, 3, 4, 5, 6, 7, 8], [19, 22, 43, 50]), ([2 ** 62, 3, -5, 7, 9, -11, 2 ** 40, 1], [0, 0, 0, 0]), ([0] * 8, [0] * 4)]
    odd = [([-2 ** 63, *[1] * 7], [0, 0, 0, 0]), ([None, *[1] * 7], [1, None, 1, 1])]
    for dialect in dsl.DIALECTS:
        for cases in (pairs, odd + pairs[:1], []):
            found = dsl.cases_batch(pa.array(scripts, pa.string()).dictionary_encode().dictionary, [(x, [None if v is None else float(v) for v in x], e) for x, e in cases], dialect, "pattern")
            n = 0
            for s, got in zip(dict.fromkeys(x for x in scripts if x is not None), found.to_pylist()):
                err, _, code, literals, out, floats, _ = g.program(s, dialect)
                want = []
                for x, e in cases:
                    v = steps.output_cells(code, literals, out, x, [None if v is None else float(v) for v in x], floats, dsl.P1, dsl.P2) if err is None else None
                    if v is None or None in e:
                        want.append(False)
                    elif floats:
                        want.append(all(a == b for a, b in zip(v[1], e)))
                    else:
                        want.append(all(a == b if a is not None else v[2][k] == b % dsl.P1 and v[3][k] == b % dsl.P2 for k, (a, b) in enumerate(zip(v[0], e))))
                n += any(want)
                assert tuple(got.values()) == (err is None if cases else got["ok"], g.count_pattern(s), want), (dialect, s)
            assert n > 3 or not cases
        wrong = dsl.cases_batch(pa.array(["C[0,0] = Q", "x"]), [([1] * 8, [1.0] * 8, [2] * 4)] * 3, dialect, "pattern").to_pylist()
        assert wrong == [{"ok": False, "n_mults": 0, "correct": [False] * 3}] * 2
    monkeypatch.setattr(dsl.batches, "MAX_LINES", 0)  # one by one
    assert dsl.cases_batch(pa.array([G.STRASSEN]), [([1] * 8, [1.0] * 8, [2] * 4)], "E2", "stars").to_pylist() == [{"ok": True, "n_mults": 7, "correct": [True]}]
