"""Context-tree scores, fill-in-the-middle and lexical search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, documents, empty, prose
from pyspark.sql import functions as F

from quadrant.llm import fill_in_middle as fim
from quadrant.llm import lexical_search as ls
from quadrant.llm import lm_scoring as lm
from quadrant.llm import queries
from quadrant.llm.common import id_remainder

SF = "/root/testdata/sf0.001"


# ---- context trees ---------------------------------------------------------------

def plain_ctw(training, depth):
    """Counts by (context, bits known), and block probabilities by plain recursion."""
    counts = Counter()

    def bits(byte):
        return [(byte >> (7 - j)) & 1 for j in range(8)]

    def steps(data):
        data = b"\0" * depth + data + b"\xff"
        for i in range(depth, len(data)):
            yield data[i - depth:i], data[i]

    for t in training:
        for context, byte in steps(t):
            for j, bit in enumerate(bits(byte)):
                for d in range(depth + 1):
                    counts[context[depth - d:], (j, byte >> (8 - j)), bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = {}
    for context, known, _ in counts:
        if context:
            children.setdefault((context[1:], known), set()).add(context)
    memo = {}

    def weighted(context, known):
        if (context, known) not in memo:
            own = kt(counts[context, known, 0], counts[context, known, 1])
            if len(context) < depth:
                below = sum(weighted(c, known) for c in children.get((context, known), ()))
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
            memo[context, known] = float(own)
        return memo[context, known]

    def one(context, known, d=0):
        node = context[depth - d:]
        a, b = counts[node, known, 0], counts[node, known, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        share = math.exp(math.log(0.5) + kt(a, b) - weighted(node, known))
        return share * own + (1 - share) * one(context, known, d + 1)

    def score(t):
        total = 0.0
        for context, byte in steps(t):
            for j, bit in enumerate(bits(byte)):
                p = one(context, (j, byte >> (8 - j)))
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def plain_base(training, t):
    counts = Counter(w for x in training for w in [*x.split(), b""])
    n, v = sum(counts.values()), len(counts)
    words = [*t.split(), b""]
    return len(words), sum(counts[w] > 0 for w in words), n, sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


TEXTS = [prose(k, 12) for k in range(14)] + ["", None, "Ünï 日本\n\x85x", "x" * 300, "The THE the", prose(3, 12), "\0\0a"]


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_equal_plain_context_trees(spark, depth):
    docs = documents(spark, TEXTS)
    got = {r.doc_id: r for r in lm.score(docs, F.col("id") % 3 != 0, depth=depth).collect()}
    data = [(t or "").encode().lower() for t in TEXTS]
    training = [t for k, t in enumerate(data) if k % 3]
    score = plain_ctw(training, depth)
    assert len(got) == len(TEXTS)
    for k, t in enumerate(data):
        n, known, total, base = plain_base(training, t)
        r = got[k]
        assert (r.trains, r.n_tokens, r.n_known, r.train_tokens) == (k % 3 != 0, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert r.score == pytest.approx(score(t), rel=1e-9, abs=1e-9)


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    docs = documents(spark, TEXTS * 3).repartition(3)
    whole = sorted((r.doc_id, r.score) for r in lm.score(docs, F.col("id") % 3 != 0).collect())
    monkeypatch.setattr(lm, "BLOCK", 200)
    monkeypatch.setattr(lm, "FLAT", 64)
    monkeypatch.setattr(lm, "SUBTREE_ROWS", 16)
    split = sorted((r.doc_id, r.score) for r in lm.score(docs, F.col("id") % 3 != 0).collect())
    assert [k for k, _ in whole] == [k for k, _ in split]
    assert [s for _, s in whole] == pytest.approx([s for _, s in split], rel=1e-9)


def test_predictions_are_a_distribution(spark):
    """Over all next bytes of a context, probabilities sum to one."""
    texts = [prose(1, 30).encode(), b"abcabcabd"]
    keys, n = lm._merged(list(lm._piece_grams(texts, [True, True], 4)))
    context = np.uint64(int.from_bytes(b" eht", "big"))  # the latest byte first
    asked = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    keys, n = lm._tallied(np.concatenate([keys, asked]), np.concatenate([n, np.zeros(256, np.int64)]))
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n)], "gram long, n long").coalesce(1)
    prices = {r.gram: r.value for r in lm._prices(counts, lm._tops(counts, 4), 4).collect()}
    assert sum(10 ** prices[int(k)] for k in asked) == pytest.approx(1.0)


def test_scores_of_awkward_rows(spark):
    rows = awkward(spark)
    got = lm.score(rows, id_remainder("id", 5) != 1)
    assert got.columns == ["doc_id", "trains", "n_bytes", "n_tokens", "n_known", "base_score", "score",
                           "train_tokens", "bits_per_byte"]
    got = got.collect()
    assert len(got) == rows.count()
    blank = [r for r in got if r.n_bytes == 0]
    assert len(blank) == 3 and all(r.n_tokens == 1 for r in blank)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert lm.score(empty(spark), F.lit(True)).count() == 0
    untrained = lm.score(documents(spark, ["ab", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [r.score for r in untrained] == pytest.approx([-24 * math.log10(2), -8 * math.log10(2)])
    assert [(r.base_score, r.n_known, r.train_tokens) for r in untrained] == [(0.0, 0, 0)] * 2


def test_held_out_texts_are_predicted(spark):
    got = queries.op11_lm_scoring(spark, SF)
    held, n = got.filter("held_out").agg(F.avg("bits_per_byte"), F.count("*")).first()
    assert n > 20 and held < 4.0


# ---- fill in the middle ----------------------------------------------------------

def plain_fim(key, text, seed="7", rate=100, spm_rate=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


LINES = ["", None, "one", "one\n", "\n", "\n\n\n", "a\r\nb\rc\n", "x <P> y\nz", "ends with <\nS>\n<", "Ü\n日本\n🙂\nß",
         "\n".join(prose(k, k % 9) for k in range(500)), "y" * 100_000 + "\n" + "z\n" * 5_000, "p>\nm>\n<"]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 80)])
def test_outputs_equal_plain_cutting(spark, rate, spm_rate):
    docs = documents(spark, LINES * 20)
    got = {r.doc_id: r for r in fim.transform(docs, rate=rate, spm_rate=spm_rate)
           .withColumn("back", fim.restored()).collect()}
    for k, t in enumerate(LINES * 20):
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(k, t or "", "7", rate, spm_rate)
        assert r.back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("error", [2, 16, 512, 1 << 20])
def test_rank_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(error)
    for offsets in (np.zeros(0, int), np.array([7]), np.arange(5000) * 31, np.cumsum(rng.integers(1, 200, 20_000)),
                    np.cumsum(rng.zipf(1.3, 5000).clip(1, 10 ** 6)), np.cumsum(10 ** rng.integers(0, 6, 3000))):
        index = fim.RankIndex(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.select(ranks) == offsets).all()
        assert (abs(index.predict(ranks) - offsets) <= error).all()
        assert len(index.first) <= max(1, len(offsets))
    straight = fim.RankIndex(np.arange(100_000) * 80 + rng.integers(0, 60, 100_000), 512)
    assert len(straight.first) < 20  # the index is far smaller than the offsets


def test_fim_of_awkward_rows(spark):
    rows = awkward(spark)
    got = fim.transform(rows).withColumn("back", fim.restored())
    texts = Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert Counter((r.doc_id, r.back) for r in got.collect()) == texts
    assert all(r.form == "plain" for r in got.filter("back = ''").collect())
    assert fim.transform(empty(spark)).count() == 0
    null_key = got.filter("doc_id IS NULL").first()
    assert null_key.output == plain_fim("", null_key.back)[4]


# ---- lexical search --------------------------------------------------------------

def plain_search(docs, items, k):
    """Every document's score for every item."""
    def terms(t):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = "item_id long, text string"


def found(docs, items, k=10):
    return sorted((tuple(r) for r in ls.top_documents(docs, items, k).collect()), key=str)


@pytest.mark.parametrize("shard, step, split", [(8192, 16, 1 << 22), (7, 1, 64), (50, 4, 200)])
def test_search_equals_plain_ranking(spark, monkeypatch, shard, step, split):
    monkeypatch.setattr(ls, "SHARD", shard)
    monkeypatch.setattr(ls, "STEP", step)
    monkeypatch.setattr(ls, "QUERY_BYTES", split)
    texts = [prose(k, 5 + k % 37) for k in range(300)] + [prose(2, 9)] * 25 + ["", None, "Fox-fox FOX_fox", "日本 fox 日本"]
    items = [(k, prose(k, 6)) for k in range(8)] + [(50, "fox fox owl"), (51, ""), (52, None), (53, "zzz"), (54, "日本"),
                                                    (55, prose(2, 9)), (0, prose(0, 6))]
    got = found(documents(spark, texts).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got == plain_search(list(enumerate(texts)), items, 10)


def test_search_stops_early():
    """Frequent low-impact postings below the k-th score are not read."""
    rng = np.random.default_rng(1)
    n = 8000
    lengths = rng.integers(50, 4000, n).tolist()
    found = [[0, 1] if i % 200 == 0 else [0] for i in range(n)]
    counts = [[5, 9] if i % 200 == 0 else [1] for i in range(n)]
    shard = ls.Shard(list(range(n)), lengths, found, counts, np.array([3, 4000]), n, sum(lengths))
    best = shard.search({0: 1, 1: 1}, 10, 1)
    assert len(best) >= 10 and {r % 200 for _, r in best} == {0}
    assert len(best) < n // 10


def test_search_of_awkward_rows(spark):
    rows = awkward(spark)
    items = [(1, prose(1)), (2, "one x"), (None, "fox"), (3, None)]
    table = spark.createDataFrame([(*i, 1, "c") for i in items], f"{ITEMS}, score long, doc_id string")
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    assert found(rows, table) == plain_search(texts, items, 10)
    assert found(empty(spark), table) == []
    assert found(rows, table.limit(0)) == []


def test_length_norms_beyond_a_long():
    lengths = np.array([1, 10 ** 9, 7 * 10 ** 8])
    assert ls.length_norms(lengths, 10 ** 12, 10 ** 15).tolist() == [25 + 75 * int(n) * 10 ** 12 // 10 ** 15 for n in lengths]


def test_contract_columns(spark):
    assert queries.op11_lm_scoring(spark, SF).columns[:7] == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = {r.doc_id: r.held_out for r in queries.op11_lm_scoring(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 1) for k, h in held.items())
    assert queries.op12_fill_in_middle(spark, SF).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.op13_lexical_search(spark, SF).columns == ["item_id", "rank", "doc_id", "score"]


# ---- token counts: chunks on real lengths ----------------------------------------

def test_counts_splice_many_documents(spark):
    """Hundreds of boundaries are spliced in the given documents, and every count is the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quadrant.llm import token_counts
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    counter = token_counts.TokenCounter(path)
    assert counter.by_word
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts)[1] == want
    assert sum(len(t) > token_counts.CHUNK for t in texts) >= 9 and counter.splices >= 9
    assert counter.count(texts, 4096, 64)[1] == want
    assert sum(len(t) > 4096 for t in texts) > 100 and counter.splices > 200


def test_counts_of_a_tokenizer_that_keeps_spaces():
    """Tokens that hold white space: the word path is refused, chunks still give the library's counts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quadrant.llm import token_counts
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [prose(k, 30) + "\n\n  " + prose(k + 1, 30) for k in range(20)] + ["", "  a  b ", prose(3, 900)]
    counter = token_counts.TokenCounter(path)
    assert not counter.by_word
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts)[1] == want
