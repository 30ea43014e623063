import json
import os

import golden
import pytest
from pyspark.sql import functions as F

from quadrant.operators import evaluate as ev
from quadrant.operators import score as sc
from quadrant.sources import io, tables as tb
from quadrant.streaming import best, monitor


def test_jsonl_round_trip_and_corrupt_lines(spark, tmp):
    path = os.path.join(tmp, "rows.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps({"pair_id": 1, "matrix_A_list": [[1, 2], [3, 4]], "matrix_B_list": [[5, 6], [7, 8]]}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"pair_id": 2, "A_matrix_str": "[[1, 0], [0, 1]]", "B_matrix_str": "nope"}) + "\n")
    df = io.read_matrix_rows(spark, path)
    assert len(df.collect()) == 3 and len(io.good_rows(df).collect()) == 2
    out = os.path.join(tmp, "out")
    io.write_jsonl(io.good_rows(df), out)
    back = io.good_rows(io.read_matrix_rows(spark, out))
    assert sorted(r.pair_id for r in back.collect()) == [1, 2]
    cols, first = io.peek(back, "pair_id")
    assert first["pair_id"] == 1 and "matrix_A_list" in cols


def test_empty_source_guard(spark):
    empty = spark.createDataFrame([], "x int")
    with pytest.raises(tb.EmptySource):
        tb.require_rows(empty, "empty")
    assert not tb.enough_rows(empty, 4, 16)


def test_snapshot_append_results_and_first_rows(spark, tmp):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, v string")
    io.write_results(rows, os.path.join(tmp, "r"))
    io.append_table(rows, os.path.join(tmp, "r"))
    back = io.read_snapshot(spark, os.path.join(tmp, "r"))
    assert back.count() == 6
    assert [r.k for r in io.first_rows(back, "k", 3).collect()] == [1, 1, 2]


def test_run_stamp(spark):
    from quadrant.functions import text as tx
    assert len(spark.range(1).select(tx.run_stamp()).first()[0]) == len("20250101_120000")


SCRIPTS = [golden.NAIVE8_STEPS, "<DSL>" + golden.STRASSEN + "</DSL>", golden.MISSING, golden.BUILTIN7]


def _completions(spark, folder, n_files):
    """Completions whose best count falls from 8 to 7 only in a later file."""
    os.makedirs(folder, exist_ok=True)
    rows = [(p, g, SCRIPTS[0 if p < 8 else 1] if (p + g) % 3 else SCRIPTS[2 + g % 2]) for p in range(18) for g in range(3)]
    step = len(rows) // n_files
    for i in range(n_files):
        path = os.path.join(folder, f"part-{i}.json")
        with open(path, "w") as f:
            for r in rows[i * step:(i + 1) * step]:
                f.write(json.dumps(dict(zip(("prompt_id", "gen_idx", "completion"), r))) + "\n")
        os.utime(path, (1_000_000 + i, 1_000_000 + i))  # files are taken in order of their times
    return spark.createDataFrame(rows, "prompt_id bigint, gen_idx int, completion string")


def test_stream_best_over_batches_and_replay(spark, tmp):
    folder, disc = os.path.join(tmp, "in"), os.path.join(tmp, "disc")
    every = _completions(spark, folder, 3)
    prompts = spark.range(18).select(F.col("id").alias("prompt_id"), F.lit("[[1, 2], [3, 4]]").alias("A_matrix_str"),
                                     F.lit("[[5, 6], [7, 8]]").alias("B_matrix_str"), F.lit("[[19, 22], [43, 50]]").alias("expected_C_str"))
    best.start(spark, folder, prompts, disc, os.path.join(tmp, "ck"), files_per_batch=1).awaitTermination(600)

    def found():
        return sorted((r.batch_id, r.prompt_id, r.gen_idx, r.n_mults) for r in spark.read.parquet(disc).collect())
    got = found()
    want = best.improvements(sc.score(every, prompts, 2), None).collect()
    assert [x[1:] for x in got] == sorted((r.prompt_id, r.gen_idx, r.n_mults) for r in want) and len(want) == 2
    assert {x[0] for x in got} == {0, 1}  # state of the first batch counts in the second
    again = spark.read.schema("prompt_id bigint, gen_idx int, completion string").json(os.path.join(folder, "part-1.json"))
    best.on_batch(again, 1, prompts, disc)  # a replayed batch
    assert found() == got
    assert best.stored_best(spark, f"{disc}_state", 3) == 7 and best.stored_best(spark, f"{disc}_state", 0) is None
    assert sorted(x for x in os.listdir(disc) if x.startswith("batch")) == ["batch_id=0", "batch_id=1"]  # none without rows


LOG = "run string, step bigint, logs map<string,double>"
LOG_ROWS = [(f"r{k % 2}", k, {"old/entropy": None, ("train/Entropy" if k % 3 else "kl"): float(k)}) for k in range(30)]


def _write_log(folder, rows, i):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"part-{i}.json")
    with open(path, "w") as f:
        f.writelines(json.dumps({"run": r, "step": s, "logs": x}) + "\n" for r, s, x in rows)
    os.utime(path, (1_000_000 + i, 1_000_000 + i))


def _monitored(spark, out):
    return sorted(map(tuple, spark.read.parquet(out).where("NOT closed").select("run", "step", F.round("entropy_pct", 6)).collect()), key=str)


def test_stream_monitor_state_and_restart(spark, tmp):
    """Batches of one file each; stopped after the first two and started again from its checkpoint."""
    logs = spark.createDataFrame(LOG_ROWS, LOG)
    folder, out, ck = (os.path.join(tmp, x) for x in ("logs", "out", "ck"))
    for i in range(2):
        _write_log(folder, LOG_ROWS[i * 10:(i + 1) * 10], i)
    monitor.start(spark, folder, out, ck, files_per_batch=1).awaitTermination(600)
    state = {r.key.run: r.value for r in spark.read.format("statestore").option("stateVarName", "run_state").load(ck).collect()}
    _write_log(folder, LOG_ROWS[20:], 2)
    monitor.start(spark, folder, out, ck, files_per_batch=1).awaitTermination(600)
    want = ev.entropy_monitor(logs).select("run", "step", F.round("entropy_pct", 6)).collect()
    assert _monitored(spark, out) == sorted(map(tuple, want), key=str)
    after = {r.key.run: r.value for r in spark.read.format("statestore").option("stateVarName", "run_state").load(ck).collect()}
    # one value a run, whatever the number of batches; the baseline is the first run's, the step moved on
    assert set(state) == set(after) == {"r0", "r1"}
    assert [after[r].entropy0 for r in ("r0", "r1")] == [state[r].entropy0 for r in ("r0", "r1")] == [2.0, 1.0]
    assert (after["r0"].last_step, after["r1"].last_step) == (28, 29)


def test_stream_monitor_closes_silent_runs(spark, tmp):
    folder, out, ck = (os.path.join(tmp, x) for x in ("logs", "out", "ck"))
    _write_log(folder, LOG_ROWS[:10], 0)
    with pytest.raises(ValueError):
        monitor.start(spark, folder, out, ck, idle_ms=1)
    query = monitor.start(spark, folder, out, ck, idle_ms=1, trigger_once=False, interval="1 second")
    closed = []
    for _ in range(60):
        query.awaitTermination(1)
        if os.path.exists(os.path.join(out, "_spark_metadata")):
            closed = sorted((r.run, r.step) for r in spark.read.schema(monitor.OUTPUT).parquet(out).where("closed").collect())
        if len(closed) == 2:
            break
    query.stop()
    assert closed == [("r0", 8), ("r1", 9)]


def test_monitor_replay_and_rows_without_entropy(spark, tmp):
    rows = [("a", 3, {"kl": 1.0}), ("a", 5, {"entropy": 4.0}), ("a", 4, {"entropy": 2.0}), ("a", 9, {"entropy": 1.0}),
            ("b", 1, {"loss": 2.0}), ("b", 8, None), (None, 2, {"entropy": 8.0}), (None, 7, {"entropy": 4.0})]
    logs = spark.createDataFrame(rows, LOG)
    got = monitor.replay(logs, os.path.join(tmp, "x"), slices=3)
    pct = {(r.run, r.step): r.entropy_pct for r in got.collect()}
    assert len(pct) == len(rows)
    assert {k: round(v) for k, v in pct.items() if v is not None} == {
        ("a", 4): 100, ("a", 5): 200, ("a", 9): 50, (None, 2): 100, (None, 7): 50}
    assert monitor.replay(logs.limit(0), os.path.join(tmp, "y")).count() == 0
