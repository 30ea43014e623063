"""Prefix scans, as-of joins and the lint on them, against brute force."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrant.operators import dsl, lint
from quadrant.operators import score as sc
from quadrant.operators.scan import KINDS, asof_join, prefix_scan, ranged
from quadrant.session import checkpoint_dir

FOLD = {"min": min, "max": max, "sum": sum, "count": len, "first": lambda v: v[0], "last": lambda v: v[-1]}


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small inputs stay in several ranges, so that carried values are used."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_scan(rows, kind, inclusive):
    """Of rows (group, order, value): the fold over the values up to each row, as a sorted list."""
    out = []
    for g, o, _ in rows:
        key = (o is not None, o or 0)
        before = sorted(((x is not None, x or 0), v) for h, x, v in rows if h == g and v is not None
                        and (((x is not None, x or 0) < key) or (inclusive and (x is not None, x or 0) == key)))
        values = [v for _, v in before]
        out.append((g, o, 0 if kind == "count" and not values else FOLD[kind](values) if values else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("inclusive", [True, False])
def test_scan_equals_brute_force(spark, kind, inclusive):
    rng = random.Random(5)
    ties = kind not in ("first", "last")  # of peers, first and last are not defined
    rows = [(rng.choice(["a", "b", None]) if k % 3 else "hot", rng.randrange(90) if ties else k,
             None if rng.random() < 0.3 else rng.randrange(50)) for k in range(150)] + [("n", None, 4), ("n", 1, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = prefix_scan(df, kind, "v", ["o"], "x", by=["g"], inclusive=inclusive)
    assert got.columns == ["g", "o", "v", "x"]
    assert sorted(((r.g, r.o, r.x) for r in got.collect()), key=str) == plain_scan(rows, kind, inclusive)
    whole = prefix_scan(df.drop("g"), kind, "v", ["o"], "x", inclusive=inclusive)
    if ties:
        want = plain_scan([(0, o, v) for _, o, v in rows], kind, inclusive)
        assert sorted((r.o, r.x) if r.o is not None else (-1, r.x) for r in whole.collect() if r.x is not None) == sorted(
            (o, x) if o is not None else (-1, x) for _, o, x in want if x is not None)


def test_scans_share_their_ranges_and_empty_input(spark):
    df = ranged(spark.range(1000).withColumn("v", F.col("id") % 7), ["id"])
    both = prefix_scan(prefix_scan(df, "sum", "v", ["id"], "s", dealt=True), "count", "v", ["id"], "n", dealt=True)
    assert df.select("_range").distinct().count() > 1  # the carried values are used
    assert all(r.n == r.id + 1 and r.s == sum(k % 7 for k in range(r.id + 1)) for r in both.collect())
    assert prefix_scan(df.limit(0).drop("_range"), "min", "v", ["id"], "x").count() == 0


def test_running_best_of_a_million_counts(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.col("id").alias("prompt_id"), F.lit(0).alias("gen_idx"),
                                                F.lit(True).alias("correct"), (n - F.col("id")).cast("int").alias("n_mults"))
    got = sc.running_best(df, 4)
    want = F.when(F.col("prompt_id") > 0, n - F.col("prompt_id") + 1)
    assert got.where(F.col("is_event") & F.col("best_before").eqNullSafe(want)).count() == n


def test_improvements_in_any_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(p, g, rng.randrange(5, 90), f"s{p}") for p in range(60) for g in range(3)]
    df = spark.createDataFrame(rows, "prompt_id long, gen_idx int, n_mults int, script string").repartition(4)
    got = sorted((r.prompt_id, r.gen_idx, r.n_mults, r.script) for r in sc.improvements(df, ("prompt_id", "gen_idx"), ("script",)).collect())
    want, best = [], None
    for p, g, n, s in sorted(rows):
        if best is None or n < best:
            want.append((p, g, n, s))
            best = n
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_equals_brute_force(spark, strict):
    rng = random.Random(7)
    left = [(k, rng.choice(["x", "y", None, "hot"]) if k % 2 else "hot", rng.choice([None, *range(40)])) for k in range(300)]
    right = [(rng.choice(["x", "y", None, "hot", "z"]), rng.choice([None, *range(0, 40, 3)]), rng.randrange(9)) for _ in range(120)]
    got = asof_join(spark.createDataFrame(left, "k int, g string, t int").repartition(4),
                    spark.createDataFrame(right, "g string, u int, w int").repartition(3), ["g"], "t", "u", ["u", "w"], strict, "m_")
    assert got.columns == ["k", "g", "t", "m_u", "m_w"]
    want = []
    for k, g, t in left:
        fits = [] if t is None else [(u, w) for h, u, w in right if h == g and u is not None and (u < t or (not strict and u == t))]
        want.append((k, g, t, *(max(fits) if fits else (None, None))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_asof_join_with_many_rows_at_one_place(spark):
    """Rows of one group and one time are dealt into several ranges and all see the match."""
    left = spark.range(20_000).select("id", F.lit("g").alias("g"), F.lit(5).alias("t"))
    right = spark.createDataFrame([("g", 3, "a"), ("g", 5, "b"), ("g", 7, "c")], "g string, u int, w string")
    for strict, match in ((True, "a"), (False, "b")):
        assert asof_join(left, right, ["g"], "t", "u", ["w"], strict).where(F.col("w") == match).count() == 20_000
    assert asof_join(left, right.limit(0), ["g"], "t", "u", ["w"]).where("w IS NULL").count() == 20_000


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_of_arrow_tables_equals_that_of_tables(spark, strict):
    rng = random.Random(7)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([1, None]), None if rng.random() < 0.1 else rng.choice([rng.randrange(20), 2 ** 62, -2 ** 62]))
            for k in range(300)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([1, None]), None if rng.random() < 0.1 else rng.choice([rng.randrange(20), -2 ** 62 - 1]),
              rng.choice(["x", "y", "z", None])) for _ in range(60)]
    tables = [(left, "k int, g string, h int, t bigint"), (right, "g string, h int, u bigint, w string")]
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    arrow = [pa.table({c.split()[0]: pa.array(x, kind[c.split()[1]]) for c, x in zip(names.split(", "), zip(*rows))}) for rows, names in tables]
    for carry in (["u", "w"], ["u"]):
        got = asof_join(*arrow, ["g", "h"], "t", "u", carry, strict, "p_")
        assert got["k"].to_pylist() == list(range(300)) and got["p_u"].null_count < 300
        want = asof_join(*[spark.createDataFrame(rows, names) for rows, names in tables], ["g", "h"], "t", "u", carry, strict, "p_")
        assert [tuple(r.values()) for r in got.to_pylist()] == [tuple(r) for r in want.orderBy("k").collect()]
    none = asof_join(arrow[0], arrow[1].slice(0, 0), [], "t", "u", ["w"], strict)
    assert none["w"].null_count == 300 and asof_join(arrow[0].slice(0, 0), arrow[1], ["g"], "t", "u", ["w"], strict).num_rows == 0


SCRIPTS = ["C[0,0] = M1\nM1 = A[0,0] * B[0,0]\nC[0,1] = M1 + M1", "A[0,0] = 5\nC[1,1] = A[0,0] - Q", "", "no script", None,
           "C[0,0] = 1\nC[0,1] = 2\nC[1,0] = 3\nC[1,1] = X1\nX1 = 4\nC[1,1] = X1"]


def test_lint_by_asof_join_equals_lint_in_the_row(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(SCRIPTS * 3)], "k int, script string")
    columns = ["n_uses", "n_undefined", "first_undefined_line", "n_missing_cells"]
    got = lint.lint(df, ["k"]).select("k", *columns).orderBy("k").collect()
    want = df.select("k", dsl.lint_script("script").alias("x")).select("k", *[F.col("x")[c].alias(c) for c in columns])
    assert [tuple(r) for r in got] == [tuple(r) for r in want.orderBy("k").collect()]


def test_lint_of_a_script_of_many_lines(spark):
    n = 100_000
    text = "\n".join(["M0 = A[0,0] + B[0,0]", *[f"M{k} = M{k - 1} + M{k // 2}" for k in range(1, n - 1)], "C[0,0] = M7 - ZZ"])
    df = spark.createDataFrame([(1, text), (2, "C[0,0] = 1")], "k int, script string")
    big, small = lint.lint(df, ["k"]).orderBy("k").collect()
    uses = 2 + sum(len({k - 1, k // 2}) for k in range(1, n - 1)) + 2
    assert (big.n_uses, big.n_undefined, big.first_undefined_line, big.n_missing_cells) == (uses, 1, n, 3)
    assert big.max_distance == n - 8 and small.n_missing_cells == 3


def test_lint_by_asof_join_writes_nothing(spark):
    """F1: reads and definitions were rows of a checkpoint and of shuffles, 1.3 GB of disk for 600,000 completions."""
    df = spark.createDataFrame([(k, s) for k, s in enumerate(SCRIPTS * 3)], "k int, script string").repartition(3)
    files = sum(len(names) for _, _, names in os.walk(checkpoint_dir(spark)))
    made = lint.lint(df, ["k"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    assert made.count() == len(SCRIPTS) * 3 and sum(len(names) for _, _, names in os.walk(checkpoint_dir(spark))) == files


def test_lint_of_parts_and_odd_lines(spark, monkeypatch):
    monkeypatch.setattr(lint, "PART", 40)  # several parts a batch
    scripts = [*SCRIPTS, "", "\n\n", " C[0,0] = A[0,0] * B[0,0] ;\n;\n\u3000M1 = C[0,0]\u2003\n", "m1 = A[0, 0]*2.5\nC[1,1]=M1+m1-7",
               "T1 = (A[0,0] + Q1) * (B[0,0] - Q1 + Q2)\nC[0,0] = T1 * T1 * T1", "C[0,0] = A[0,0] * B[0,0] + A[0,1] * B[1,0]", "\u00c4 = \u00c4 + 1",
               "x = 3 4\ny = x"] * 2
    for dialect in dsl.DIALECTS:
        distinct, number = lint.distinct_scripts(pa.array(scripts, pa.string()))
        found = [r for part in lint.parts(distinct) for r in lint.lint_part(part, dialect).to_pylist()]
        assert len(list(lint.parts(distinct))) > 3 and len(found) == len(distinct) == len({s for s in scripts if s is not None})
        for s, k in zip(scripts, number.to_pylist()):
            if s is None:
                assert k is None
                continue
            seen, distances = {n: 0 for n in dsl.INPUT_NAMES}, []
            for line, target, _, err, names in dsl.grammar().statements(s, dialect):
                if err is None:
                    distances += [line - seen[n] for n in names if n in seen]
                    seen[target] = line
            assert tuple(found[k].values()) == (*dsl.grammar().lint(s, dialect), sum(distances), max(distances, default=None)), (dialect, s)


def test_dictionary_compiles_each_script_once(spark, tmp):
    rows = [(k, ["C[0,0] = 1", "M1 = A[0,0] * B[0,0]\nC[0,0] = M1", "hot = 1", None][min(k % 7, 3) if k % 7 < 3 else (2 if k % 5 else 3)])
            for k in range(2_000)]
    df = spark.createDataFrame(rows, "k int, script string").repartition(4)
    made = dsl.script_dictionary(df, columns={"n": dsl.count_stars}, path=f"{tmp}/scripts")
    assert made.count() == 3 and made.agg(F.sum("n_rows")).first()[0] == sum(s is not None for _, s in rows)
    got = dsl.with_dictionary(df, made)
    want = dsl.compile_shared(df, "script", "E1", per_script_columns={"n": dsl.count_stars})
    assert got.count() == 2_000

    def told(x):
        return sorted((r.k, r.script, r.ok if r.script else None, r.err if r.script else None, r.n) for r in x.select("k", "script", "prog.ok", "prog.err", "n").collect())
    assert [t[:1] + t[2:] for t in told(got.where("script IS NOT NULL"))] == [t[:1] + t[2:] for t in told(want.where("script IS NOT NULL"))]
    assert got.where("script IS NULL AND prog IS NOT NULL").count() == 0
