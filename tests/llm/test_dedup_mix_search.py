"""Exact and near duplicates, components, mixing and search against brute force."""

import random

import numpy as np
from llm.fixtures import WORD, awkward, components, documents, empty, prose
from pyspark.sql import functions as F

from quadrant.llm import exact_dedup, simhash_neardup, source_mix, topk_search
from quadrant.llm.components import connected_components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(spark):
    docs = awkward(spark)
    rows = docs.collect()
    got = exact_dedup.duplicate_groups(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[lower(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == sorted(want, key=str)
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


def test_equal_hashes_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.lit("same").cast("binary"))
    got = exact_dedup.duplicate_groups(documents(spark, ["a", "b", "A", "c"])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 3)]


def test_deduplicate_keeps_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert len({lower(r.text) for r in docs.collect()}) == kept.count() == len({lower(r.text) for r in kept.collect()})
    assert 2 in {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()}


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)]
    edges = spark.createDataFrame([*pairs, (None, 5), (3, 3)], "u long, v long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    want = components(300, pairs)
    assert got == {n: want[n] for p in pairs if p[0] != p[1] for n in p}
    assert connected_components(edges.limit(0)).count() == 0


def near_copies():
    out = []
    for k in range(12):
        words = prose(k, 60).split()
        out.append(" ".join(words))
        out += [" ".join(words[:j] + ["changed"] + words[j + 1:]) for j in range(0, 50, 9)]
    return [*out, None, "", "two words", "TWO words", prose(3, 60).upper()]


def brute_near(rows, distance=3):
    prints = [simhash_neardup.fingerprint(t) for _, t in rows]
    bits = np.array(prints, np.uint64)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]) <= distance]
    label = components(len(rows), linked)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [(r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label, strict=True)]


def test_fingerprint_bits():
    from xxhash import xxh64_intdigest
    words = lower(near_copies()[5]).split()
    hashes = [xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    bits = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    assert simhash_neardup.fingerprint(near_copies()[5]) == bits
    assert simhash_neardup.fingerprint("A b") == xxh64_intdigest("a b", 42)


def test_near_duplicates_whole_and_split_buckets(spark):
    texts = near_copies()
    docs = documents(spark, texts)
    for distance, cell in ((3, 1024), (12, 4)):
        got = simhash_neardup.near_duplicates(docs, distance=distance, cell=cell).collect()
        want = brute_near(list(enumerate(texts)), distance)
        assert sorted(map(tuple, got)) == sorted(want)
        assert len({w[2] for w in want}) < len(set(texts))


def test_near_duplicates_awkward(spark):
    docs = awkward(spark)
    got = simhash_neardup.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_near([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    kept = simhash_neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in got})
    assert simhash_neardup.near_duplicates(empty(spark)).count() == 0


def test_deduplicate_without_ids_and_with_ids_on_unrelated_texts(spark):
    near = prose(3, 60).split()
    texts = [(None, prose(1)), (None, prose(1)), (None, prose(2)), (None, " ".join(near)), (9, " ".join([*near[:30], "changed", *near[31:]])),
             (5, "one text"), (5, "quite another one here"), (5, "one text"), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, nth int")
    prints = [simhash_neardup.fingerprint(t) for _, t in texts]
    distance = (prints[3] ^ prints[4]).bit_count()
    bits = np.array(prints, np.uint64)
    label = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if np.bitwise_count(bits[i] ^ bits[j]) <= distance])
    want = {c: min((i for (i, _), d in zip(texts, label, strict=True) if d == c and i is not None), default=None) for c in label}
    assert len(want) == 6 and list(want.values()).count(None) == 2 and list(want.values()).count(5) == 2
    got = simhash_neardup.deduplicate(docs, distance=distance).collect()
    assert sorted(((label[r.nth], r.doc_id) for r in got), key=str) == sorted(want.items(), key=str)


def test_permutation():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(source_mix.permuted(np.arange(n), n, 1, 2, 3).tolist()) == list(range(n))


def plain_slots(sources, shard, seed, drawn):
    """(number, block, turn) -> (shard, slot) of every slot: draws in order, and what is owed after them.
    sources: (number, blocks, total); drawn: the place on the line of all shares that each slot draws."""
    line = [(n, b, t) for n, b, t in sorted(sources) for _ in range(t)]
    had, out = {n: 0 for n, _, _ in sources}, {}
    for place, at in enumerate(drawn):
        n, blocks, total = line[at]
        if had[n] < total:
            j = had[n]
            out[n, int(source_mix.permuted(np.array([j % blocks]), blocks, seed, n, j // blocks)[0]), j // blocks] = divmod(place, shard)
        had[n] += 1
    place = -(-len(line) // shard) * shard
    for n, blocks, total in sorted(sources):
        for j in range(had[n], total):
            out[n, int(source_mix.permuted(np.array([j % blocks]), blocks, seed, n, j // blocks)[0]), j // blocks] = divmod(place, shard)
            place += 1
    return out


def test_slots_are_drawn_per_shard(spark):
    sizes = [(0, 64 * 40, 64.0 * 55), (1, 64 * 200, 64.0 * 90), (2, 64 * 3, 64.0 * 9), (3, 64 * 500, 64.0 * 146)]
    sources = spark.createDataFrame([(n, s, t) for n, s, t in sizes], "number long, source_size long, target double")
    got = source_mix.slots(sources, shard=32, seed=5).collect()
    total = {n: int(t // 64) for n, _, t in sizes}
    everything = sum(total.values())
    drawn = [r.d for r in spark.range(everything).selectExpr("id", f"pmod(xxhash64(5, id), {everything}L) AS d").orderBy("id").collect()]
    want = plain_slots([(n, s // 64, total[n]) for n, s, _ in sizes], 32, 5, drawn)
    assert {(r.number, r.block, r.turn): (r.shard, r.slot) for r in got} == want and len(got) == everything
    # the counts of a shard are a draw from the shares, not the shares themselves
    first = [sum(r.number == n for r in got if r.shard == 0) for n in total]
    assert sum(first) <= 32 and len({tuple(sum(r.number == n for r in got if r.shard == k) for n in total) for k in range(9)}) > 1
    last = -(-everything // 32)
    assert 0 < sum(r.shard >= last for r in got) < everything // 4  # balancing shards


def level_targets(sizes, weights=(5, 2, 1), repeats=3):
    """The reshare rule, literally."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
        free -= over
    return target


def test_mix(spark):
    docs = documents(spark, [prose(k, 30 + k % 90) for k in range(300)], lambda k: ["b", "a", None, "tiny"][0 if k < 200 else 1 + k % 2 if k < 298 else 3])
    docs = docs.union(awkward(spark).select(docs.columns))
    rows = docs.collect()
    got = source_mix.taken(docs, shard=16).collect()
    again = source_mix.taken(docs.repartition(7), shard=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = level_targets(sizes)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r.text or "")) for r in rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        source = next(s for s in sizes if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6)
        taken[source] = taken.get(source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= 1.5 * source_mix.BLOCK, (s, t, taken)
    assert source_mix.taken(empty(spark)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    docs = documents(spark, [prose(k, 30 + k % 90) for k in range(120)], lambda k: "abc"[k % 3]).union(awkward(spark).select(*documents(spark, ["x"]).columns))
    mixed = source_mix.mixed_documents(docs, shard=16)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = {}
    for r in source_mix.taken(docs, shard=16).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}
    assert source_mix.mixed_documents(empty(spark)).count() == 0


def test_mixed_shards_hold_the_drawn_slots(spark):
    docs = documents(spark, [prose(k, 30 + k % 90) for k in range(120)], lambda k: ["a", "b", None][k % 3]).union(
        awkward(spark).select(*documents(spark, ["x"]).columns))
    got = source_mix.mixed_shards(docs, shard=16).collect()
    places, words, want = [], {}, {}
    for r in got:
        places.append((r.shard, r.slot))
        words.setdefault(r.source, []).extend(WORD.findall(r.text))
        assert 0 < len(WORD.findall(r.text)) <= source_mix.BLOCK
    for r in source_mix.mixed_documents(docs, shard=16).collect():
        want.setdefault(r.source, []).extend(WORD.findall(r.text))
    assert {s: sorted(w) for s, w in words.items()} == {s: sorted(w) for s, w in want.items()}
    assert len(set(places)) == len(places) and all(0 <= slot < 16 for _, slot in places)
    assert max(shard for shard, _ in places) > 1
    assert source_mix.mixed_shards(empty(spark)).count() == 0


def test_mix_of_very_many_tiny_sources(spark):
    docs = documents(spark, [prose(k, 24) for k in range(600)], lambda k: f"s{k:03}")
    got = source_mix.taken(docs, weights=(1, 2, 5)).collect()
    light = [r for r in got if r.target < 12]
    assert len(light) == 200
    assert abs(sum(r.taken for r in light) - sum(r.target for r in light)) < 0.3 * sum(r.target for r in light)
    assert abs(sum(r.taken for r in got) - 600 * 24) < 0.1 * 600 * 24


def test_mixed_documents_of_a_row_under_two_sources(spark):
    text = prose(1, 90)
    docs = spark.createDataFrame([(1, text, "en", s, 1) for s in ("a", "b", None)], documents(spark, ["x"]).schema)
    got = source_mix.mixed_documents(docs, weights=(1,)).collect()
    assert sorted((r.doc_id, r.source or "", r.text) for r in got) == [(1, s, text) for s in ("", "a", "b")]


def test_search(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(400, 8)) * 2, 1)
    vectors[100:250] = vectors[100]  # one very common vector: ties
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(500, None), (505, [1.0, None, *[0.0] * 6]), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (520, []), (525, [1.0, 2.0]),
           (530, [3.0, 4.0]), (None, [1.0] * 8), (7, rows[7][1]), (540, [3.0e30] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, shard string, number int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df, F.col("id") % 5 == 0, shard=60).collect())
    usable = [(k, np.floor(256 * np.array(v, np.float32).astype(float))) for k, v in rows + odd
              if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want, limit = [], 2**63 - 1024
    for q, a in usable:
        if q % 5 == 0 and q < 540:
            scored = sorted((-max(-limit, min(limit, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))), k)
                            for k, b in usable if k != q and len(a) == len(b))
            want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:5])]
    big = {540}
    assert [g for g in got if g[0] not in big and g[2] not in big] == [w for w in sorted(want) if w[2] not in big]
    assert {g[0] for g in got} >= big and len([g for g in got if g[2] in big]) == len([w for w in want if w[2] in big])
    assert topk_search.top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_search_seeds_in_all_shards(spark, monkeypatch):
    asked, searched = [], topk_search._searched
    monkeypatch.setattr(topk_search, "_searched", lambda rows, k: asked.append(
        [(r.shard, r.number) for r in rows.filter("number IS NOT NULL").collect()]) or searched(rows, k))
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(400)], "vec_id long, embedding array<float>")
    topk_search.top_k(df, F.col("id") % 5 == 0, shard=100).collect()
    first, second = asked
    assert len(first) == len({n for _, n in first}) == 80 and {s for s, _ in first} == {0, 1, 2, 3}
    assert sorted(first + second) == [(s, n) for s in range(4) for n in sorted({n for _, n in first})]


def brute_search(rows, k=5):
    """(query, rank, id, score) of integer vectors, by plain integers; queries are ids divisible by 5."""
    out = []
    for q, a in rows:
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search_of_one_id_with_different_vectors(spark):
    rng = random.Random(5)
    rows = [(k % 40 if k % 5 else k, [rng.randrange(-99, 99) for _ in range(4)]) for k in range(400)]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>")
    for shard in (1000, 50):
        got = topk_search.top_k(df, F.col("id") % 5 == 0, factor=1, shard=shard).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_search(rows)


def test_search_of_very_large_vectors(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice((-1, 1)) * (rng.randrange(4) + base) for _ in range(4)]) for k in range(200)
            for base in [(5, 2**27, 2**33, 2**52)[k % 4]]]
    rows += [(200, [2**900] * 4), (201, [-(2**900), 2**900, 1, 0]), (202, [2**62, -(2**62), 3, 1])]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>")
    assert [[int(x) for x in r.v] for r in df.orderBy("vec_id").select(topk_search.scaled("embedding", 1).alias("v")).collect()] == [v for _, v in rows]
    want = [(q, n, i, max(-topk_search.LAST, min(topk_search.LAST, s))) for q, n, i, s in brute_search(rows)]
    assert len({s for *_, s in want if 2**53 < s < 2**63 - 1}) > 10
    for shard in (1000, 30):
        got = topk_search.top_k(df, F.col("id") % 5 == 0, factor=1, shard=shard).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    scores = sorted([3, -(2**63), 2**63, 2**63 - 1, 1 - 2**63, 2**64, -(2**700), 2**700], reverse=True)
    order = sorted(scores, key=lambda s: (-max(-topk_search.LAST, min(topk_search.LAST, s)), topk_search.order_key(s) or b""))
    assert order == scores and [topk_search.from_key(s, topk_search.order_key(s)) for s in scores] == scores
