"""Language, quality, tool calls and the pipeline."""

import random

import public_tokenizers
import sentencepiece
from llm.fixtures import DOCUMENTS, awkward, empty, prose
from pyspark.sql import functions as F

import corpus_pipeline
from quadrant.llm import language_id, quality_classifier, queries, tool_calls
from quadrant.llm.common import id_remainder

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language_id(spark, SF).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(spark):
    docs = awkward(spark)
    found = language_id.learn(docs, sample=10)
    assert found.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, found).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert got[9].lang_pred == "en"
    nothing = language_id.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), found).count() == 0
    assert language_id.learn(empty(spark)).languages == []


def test_masks_name_every_language(spark):
    rows = [(k, "alpha beta", f"l{k % 70:02}", "s", 1) for k in range(280)] + [(900 + k, "gamma delta", "l69", "s", 1) for k in range(9)]
    found = language_id.learn(spark.createDataFrame(rows, DOCUMENTS))
    assert found.table.shape[0] == 2  # 70 languages: two words of bits
    total, hits = found.hits(["alpha", "delta"])
    assert (hits[0, :69] == total[0]).all() and hits[1, 69] == total[1] and hits[1, :69].max() < total[1]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op3_quality_classifier(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.predicted for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.6
    ranks = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in got if a.quality for b in got if not b.quality]
    assert sum(ranks) / len(ranks) > 0.97


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (9, 1), (7, 1), (8, 0), (6, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    model = quality_classifier.learn(docs, labels, F.lit(True))
    got = quality_classifier.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    unlabelled = quality_classifier.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_classifier.scores(docs, unlabelled).collect()} == {0.5}
    kept = quality_classifier.with_scores(docs, model, score="points")
    assert kept.columns == [*docs.columns, "points"]
    assert quality_classifier.scores(empty(spark), model).count() == 0


SCHEMAS = {"find": [tool_calls.Param("text", "string", True, 1, 5), tool_calls.Param("n", "integer", False, 1, 9),
                    tool_calls.Param("kind", "string", allowed=("x", "y"))]}


def call(conv, cid, turn, args, deps=(), name="find"):
    return (conv, cid, turn, name, args, list(deps) if deps is not None else None)


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        call(1, "a", 0, '{"text":"ok","n":1.50,"kind":"z"}'), call(1, "b", 1, '{"n": 3, "text": "ok"}', ["c", "a"]),
        call(1, "c", 2, '{"text":"too long"}', ["a"]), call(1, "d", 3, '{"text":"x","text":"y"}', ["gone"]),
        call(2, "p", 0, "{}", ["q"]), call(2, "q", 1, None, ["p"]), call(2, "r", 2, '{"text":"x","other":1}', ["q"]),
        call(3, "s", 0, '{"text":1}', ["s"]), call(None, "t", 0, '{"text":"x"}'), call(4, None, 0, "[1]", None),
        call(5, "u", None, '{"text":"x"}', [None]), call(5, "u", None, '{"text":"x"}', [None]), call(6, "v", 0, "{}", (), "other"),
    ], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 4, "first"), (1, "b", 2, "r\n\"é"), (9, "z", 1, "lost"), (5, "u", None, None), (None, "t", 1, "x")],
                                    "conv_id long, call_id string, turn long, content string")
    rows = tool_calls.link(calls, results, SCHEMAS).collect()
    got = {(r.conv_id, r.call_id): (r.status, r.level, r.errors) for r in rows}
    assert len(rows) == 14
    assert got == {
        (1, "a"): ("many_results", 0, "type n,value kind"), (1, "b"): ("linked", 2, ""), (1, "c"): ("no_result", 1, "range text"),
        (1, "d"): ("no_result", 0, "not an object,unknown call gone"), (2, "p"): ("no_result", None, "missing text"),
        (2, "q"): ("no_result", None, "not an object"), (2, "r"): ("no_result", None, "unknown other"), (3, "s"): ("no_result", None, "type text"),
        (None, "t"): ("no_id", 0, ""), (4, None): ("no_id", 0, "not an object"), (5, "u"): ("linked", 0, ""),
        (6, "v"): ("no_result", 0, "unknown tool"), (9, "z"): ("orphan_result", None, "")}
    record = {r.call_id: r.record for r in rows}
    assert record["b"] == ('{"arguments":{"n":3,"text":"ok"},"call_id":"b","depends_on":["a","c"],"errors":[],"level":2,'
                           '"name":"find","result":"r\\n\\"é","status":"linked"}')
    assert '"result":"first"' in record["a"] and '{"kind":"z","n":1.5,"text":"ok"}' in record["a"]
    assert tool_calls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_levels_of_any_graph(spark):
    rng = random.Random(3)
    edges = {(1, f"c{k}", f"c{k - 1}") for k in range(1, 300)}                                  # a long chain
    edges |= {(2, f"n{k}", f"n{rng.randrange(k)}") for k in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
    edges |= {(3, "a", "b"), (3, "b", "a"), (3, "x", "a"), (3, "y", "x"), (3, "y", "z"), (3, "w", "z"), (4, "s", "s")}
    parents = {}
    for conv, call, parent in edges:
        parents.setdefault((conv, call), set()).add((conv, parent))
    want = {}
    for _ in range(400):
        for node, above in parents.items():
            known = [want.get(p) if p in parents else 0 for p in above]
            if None not in known:
                want[node] = max(known) + 1
    df = spark.createDataFrame(sorted(edges), "conv_id long, call_id string, parent_id string")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(df).collect()}
    assert got == {node: want.get(node) for node in parents}
    assert tool_calls.levels(df.limit(0)).count() == 0


def test_tool_calls_of_odd_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "more"), (None, 0, "user", "x"),
            (2, None, "user", None), (2, 3, None, "x"), (3, 2, "user", ""), (3, 3, "system", None)]
    talk = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, call_id int")
    got = sorted((r.status for r in tool_calls.link(tool_calls.calls_of(talk), tool_calls.results_of(talk), tool_calls.SCHEMAS).collect()))
    assert got == sorted(["many_results"] * 2 + ["orphan_result"] + ["no_id"] * 2 + ["no_result"] * 2)


def test_pipeline_on_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == corpus_pipeline.COLUMNS


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_pipeline_against_plain_stages(spark):
    """Each stage on the one before's rows, recomputed plainly."""
    import numpy as np

    from llm.fixtures import WORD, components
    from quadrant.llm.simhash_neardup import fingerprint

    docs, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        seen.append(docs.collect())
    good, exact, near, mixed, encoded = seen
    best = {}
    for r in good:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    bits = np.array([fingerprint(r.text) for r in exact], np.uint64)
    label = components(len(exact), [(i, j) for i in range(len(exact)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]) <= 3])
    least = {}
    for r, c in zip(exact, label, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted(least.values())
    size = {r.doc_id: len(WORD.findall(r.text)) for r in near}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert all(taken[k] <= 3 * size[k] for k in taken)
    assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.ids, r.decoded) for r in encoded) == sorted(
        (r.doc_id, ids := [1, *sp.encode(r.text), 2], sp.decode(ids)) for r in mixed)


def test_queries_need_only_their_columns(spark):
    assert id_remainder("doc_id", 4) is not None
    assert spark.createDataFrame([(None,)], "doc_id long").select(id_remainder("doc_id", 4)).first()[0] == 0
    rng = random.Random(1)
    ids = [rng.randrange(10**9) for _ in range(50)]
    import zlib
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(id_remainder("doc_id", 5)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def test_a_labelled_id_on_many_documents(spark):
    """An id that thousands of rows carry teaches once, so it neither outweighs others nor fills the driver."""
    from quadrant.llm import quality_classifier
    good = [(k, prose(k, 60), "en", "s", 1) for k in range(0, 60, 2)]
    bad = [(k, "BUY now!!! $$$ click " * 20 + str(k), "en", "s", 1) for k in range(1, 60, 2)]
    docs = spark.createDataFrame(good + bad, DOCUMENTS)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    once = quality_classifier.learn(docs, labels, F.lit(True))
    again = quality_classifier.learn(docs.union(spark.range(3000).selectExpr("4L", "'zzz'", "'en'", "'s'", "1L")), labels, F.lit(True))
    assert (once.good, once.bad) == (again.good, again.bad)


def test_integers_however_spelled(spark):
    calls = spark.createDataFrame([(k, "c", 0, "find", '{"text":"ab","n":%s}' % n, []) for k, n in enumerate(["3", "3.0", "3e0", "30E-1", "2.5", "25e-1", "1e2"])],
                                  "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = [r.errors for r in tool_calls.link(calls, results, SCHEMAS).orderBy("conv_id").collect()]
    assert got == ["", "", "", "", "type n", "type n", "range n"]
