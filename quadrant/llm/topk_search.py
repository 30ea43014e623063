"""Exact top-k inner-product search: ball trees and branch and bound per shard.

Vectors are dealt by hash into shards of about ``SHARD`` rows.  A task reads a shard's
vectors, builds a ball tree over them, and then streams the queries past it.
A node's best possible score for a query is q.c + r|q| (c its centre, r its
radius); nodes whose bound cannot beat a query's current k-th result are cut off
with all below them, and a query's leaves are visited from the highest bound down, so
that its k-th result rises early.  That k-th result is shared: every query first
meets one shard, its own by a hash of its number, and takes its k-th result from there into all others.

A query row is sent to every shard, so what moves grows with queries x shards;
no task holds more than its shard and a batch of queries, and a shard gives at most k
rows a query.  Work is exact: components are integers, and a score is computed in doubles
only where its bound is below 2^53, else in Python integers.  Those are compared as they are; only the
score reported is held to the range of a long, and a key of bytes keeps their order between shards.

Defined results: a vector that is null, or holds a null or non-finite component, takes
no part; nor does a null id.  Rows with the query's own id are its own and no
candidates of it; rows repeated with the same id and vector are each a candidate of others, and one
query; rows of one id with different vectors are candidates and queries of their own; vectors are compared with those of equal length only (an empty one has score 0);
ties go to the smaller id; an empty table gives an empty result.  Columns not
named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import narrow
from quadrant.session import materialize

SHARD, LEAF, BATCH = 8192, 64, 1024
EXACT = 2.0**53
LAST = 2**63 - 1       # scores are reported from -LAST to LAST


def scaled(embedding: str, factor: int = 256) -> Column:
    """floor(factor * x) of every component, null if the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.lit(float(np.finfo(np.float64).max))

    def whole(x: Column) -> Column:  # doubles beyond EXACT are integers, and F.floor stops at a long
        wide = F.greatest(F.least(x.cast("double") * factor, largest), -largest)
        return F.when(F.abs(wide) < EXACT, F.floor(wide).cast("double")).otherwise(wide)

    return F.when(~bad, F.transform(embedding, whole))


def order_key(score: int) -> bytes | None:
    """Bytes that sort scores at or beyond the ends of a long, the largest first; None inside."""
    if abs(score) < LAST:
        return None
    size = abs(score).bit_length() // 8 + 1
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + raw if score < 0 else b"\x00" + bytes(255 - b for b in raw)


def from_key(score: int, key: bytes | None) -> int:
    if key is None:
        return score
    return -int.from_bytes(key[5:], "big") if key[0] else int.from_bytes(bytes(255 - b for b in key[5:]), "big")


class BallTree:
    """Vectors of one length, in balls of at most ``LEAF`` (equal vectors included)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.centres, self.radii, self.low_id, self.children, self.leaf = [], [], [], [], []
        self._build(ids, vectors)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.peak = np.abs(vectors).max(initial=0.0)
        with np.errstate(over="ignore"):
            self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        self.low_id = np.array(self.low_id)

    @np.errstate(over="ignore", invalid="ignore")
    def _build(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.radii)
            if parent >= 0:
                self.children[parent][side] = node
            here = vectors[rows]
            centre = here.mean(axis=0)
            away = np.sqrt(((here - centre) ** 2).sum(axis=1))
            self.centres.append(centre)
            self.radii.append(away.max() if np.isfinite(away).all() else np.inf)
            self.low_id.append(ids[rows].min())
            self.children.append([-1, -1])
            if len(rows) <= LEAF:
                self.leaf.append((ids[rows], here))
                continue
            self.leaf.append(None)
            one = here[away.argmax()]
            other = here[((here - one) ** 2).sum(axis=1).argmax()]
            left = ((here - one) ** 2).sum(axis=1) < ((here - other) ** 2).sum(axis=1)
            if not left.any() or left.all():  # equal vectors: by id
                order = ids[rows].argsort(kind="stable")
                left = np.zeros(len(rows), bool)
                left[order[:len(rows) // 2]] = True
            todo += [(rows[left], node, 0), (rows[~left], node, 1)]

    def bounds(self, queries: np.ndarray, norms: np.ndarray, node: int) -> np.ndarray:
        """The best integer score that each query can have below a node."""
        with np.errstate(over="ignore", invalid="ignore"):
            middle, slack = queries @ self.centres[node], 1e-6 + 1e-9 * norms * self.reach[node]
            bound = np.floor(middle + norms * self.radii[node] + slack)
        return np.where(np.isfinite(bound), bound, np.inf)

    def search(self, queries: np.ndarray, own: np.ndarray, best: np.ndarray, best_id: np.ndarray,
               here: np.ndarray) -> None:
        """Merge this tree's results into best and best_id (a row a query, best first); here marks them."""
        with np.errstate(over="ignore"):
            norms = np.sqrt((queries**2).sum(axis=1))

        def alive(rows, bound, node):
            kth = best[rows, -1]
            return (bound > kth) | ((bound == kth) & (self.low_id[node] < best_id[rows, -1]))

        leaves: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            bound = self.bounds(queries[rows], norms[rows], node)
            keep = alive(rows, bound, node)
            rows, bound = rows[keep], bound[keep]
            if not len(rows):
                continue
            if self.leaf[node] is not None:
                leaves.append((node, rows, bound))
            else:
                todo += [(child, rows) for child in self.children[node]]
        if not leaves:
            return
        # Each query's most promising leaf first, then the others by their highest bound.
        top = np.full(len(queries), -np.inf)
        at = np.zeros(len(queries), np.int64)
        for k, (_, rows, bound) in enumerate(leaves):
            better = bound > top[rows]
            top[rows[better]], at[rows[better]] = bound[better], k
        for k, (node, rows, _) in enumerate(leaves):
            self._visit(node, rows[at[rows] == k], queries, own, best, best_id, here)
        for k in sorted(range(len(leaves)), key=lambda k: -leaves[k][2].max()):
            node, rows, bound = leaves[k]
            left = (at[rows] != k) & alive(rows, bound, node)
            self._visit(node, rows[left], queries, own, best, best_id, here)

    def _visit(self, node, rows, queries, own, best, best_id, here) -> None:
        if not len(rows):
            return
        ids, vectors = self.leaf[node]
        score = inner(queries[rows], vectors)
        score[own[rows][:, None] == ids[None, :]] = -np.inf
        score = score.astype(best.dtype, copy=False)
        kth, kth_id = best[rows, -1][:, None], best_id[rows, -1][:, None]
        hit = ((score > kth) | ((score == kth) & (ids[None, :] < kth_id) & (score > -np.inf))).any(axis=1)
        rows, score = rows[hit], score[hit]
        if len(rows):
            k = best.shape[1]
            all_score = np.concatenate([best[rows], score], axis=1)
            all_id = np.concatenate([best_id[rows], np.broadcast_to(ids, score.shape)], axis=1)
            all_here = np.concatenate([here[rows], np.ones(score.shape, bool)], axis=1)
            falling = -all_score
            if best.dtype == object:  # lexsort needs numbers: places among all scores
                falling = np.unique(falling, return_inverse=True)[1].reshape(falling.shape)
            order = np.lexsort((all_id, falling), axis=-1)[:, :k]
            here[rows] = np.take_along_axis(all_here, order, 1)
            best[rows] = np.take_along_axis(all_score, order, 1)
            best_id[rows] = np.take_along_axis(all_id, order, 1)


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles if all are exact, else with Python
    integers in place of those that may not be."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = queries @ vectors.T
        if not vectors.size or np.abs(queries).max() * np.abs(vectors).max() * vectors.shape[1] < EXACT:
            return score
        peaks = np.abs(queries).max(axis=1)[:, None] * np.abs(vectors).max(axis=1)[None, :] * vectors.shape[1]
    score = score.astype(object)
    wide = ~(peaks < EXACT)
    whole = {c: [int(x) for x in vectors[c]] for c in np.flatnonzero(wide.any(axis=0)).tolist()}
    for r in np.flatnonzero(wide.any(axis=1)).tolist():
        query = [int(x) for x in queries[r]]
        for c in np.flatnonzero(wide[r]).tolist():
            score[r, c] = sum(a * b for a, b in zip(query, whole[c], strict=True))
    return score


class Best:
    """k best so far of some queries, from seeds where there are any."""

    def __init__(self, seeds_score: list, seeds_id: list, k: int, wide: bool):
        n = len(seeds_score)
        self.score, self.id = np.full((n, k), -np.inf, object if wide else np.float64), np.full((n, k), np.iinfo(np.int64).max)
        self.here = np.zeros((n, k), bool)  # false: a seed, reported by its own shard
        for r, (s, i) in enumerate(zip(seeds_score, seeds_id, strict=True)):
            self.score[r, :len(s or [])], self.id[r, :len(i or [])] = s or [], i or []


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (as a matrix) by length."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    start = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = rows, flat[start[rows][:, None] + np.arange(d)[None, :]]
    return out


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """rows: shard, number (null: a candidate), id, vec, seed_score, seed_key, seed_id;
    gives number, id, score, key: a shard's best k for each query that meets it."""
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("key", T.BinaryType())])
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("number").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gathered, trees = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                shards = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = batch.slice(a, b - a)
                    if shards[a] != shard:
                        shard, gathered, trees = shards[a], [], None
                    n = part.column(1).null_count
                    if n:
                        gathered.append(part.slice(0, n))
                    if n < part.num_rows:
                        if trees is None:
                            trees, gathered = _trees(gathered), []
                        yield _answer(part.slice(n), trees, k)

    return dealt.select("shard", "number", "id", "vec", "seed_score", "seed_key", "seed_id").mapInArrow(run, schema)


def _trees(parts: list[pa.RecordBatch]) -> dict[int, BallTree]:
    if not parts:
        return {}
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
    gathered: dict[int, list] = {}
    for batch in whole:
        ids = np.asarray(batch.column(2))
        for d, (rows, vectors) in _vectors(batch.column(3)).items():
            gathered.setdefault(d, []).append((ids[rows], vectors))
    return {d: BallTree(np.concatenate([x[0] for x in g]), np.concatenate([x[1] for x in g]))
            for d, g in gathered.items()}


def _answer(queries: pa.RecordBatch, trees: dict[int, BallTree], k: int) -> pa.RecordBatch:
    number, own = np.asarray(queries.column(1)), np.asarray(queries.column(2))
    scores, keys, seed_ids = (queries.column(c).to_pylist() for c in (4, 5, 6))
    seeds = [[from_key(*s) for s in zip(ss or [], ks or [], strict=True)] for ss, ks in zip(scores, keys, strict=True)]
    out = []
    for d, (rows, vectors) in _vectors(queries.column(3)).items():
        if d in trees:
            peak = np.abs(vectors).max(initial=0.0)
            with np.errstate(over="ignore"):
                wide = not peak * trees[d].peak * d < EXACT or any(abs(s) >= EXACT for r in rows for s in seeds[r])
            best = Best([seeds[r] for r in rows], [seed_ids[r] for r in rows], k, wide)
            trees[d].search(vectors, own[rows], best.score, best.id, best.here)
            q, c = np.nonzero((best.score > -np.inf) & best.here)
            score, key = best.score[q, c], np.full(len(q), None, object)
            if wide:
                exact = [int(s) for s in score]
                key[:] = [order_key(s) for s in exact]
                score = np.array([max(-LAST, min(LAST, s)) for s in exact], np.int64)
            out.append((number[rows][q], best.id[q, c], score.astype(np.int64), key))
    kinds = {"number": pa.int64(), "id": pa.int64(), "score": pa.int64(), "key": pa.binary()}
    cols = [np.concatenate([o[j] for o in out]) if out else [] for j in range(len(kinds))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          factor: int = 256, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for every row
    that meets ``is_query`` (a condition on ``vec_id``)."""
    rows = (narrow(vectors, id=vec_id, embedding=embedding)
            .select("id", scaled("embedding", factor).alias("vec"), is_query.alias("asks"))
            .filter("id IS NOT NULL AND vec IS NOT NULL"))
    shards = max(1, math.ceil(rows.count() / shard))
    candidates = rows.select(F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int").alias("shard"),
                             F.lit(None).cast("long").alias("number"), "id", "vec")
    queries = materialize(rows.filter("asks").select("id", "vec").distinct()
                          .select(F.monotonically_increasing_id().alias("number"), "id", "vec"))
    nothing = F.array().cast("array<long>")
    bare = [F.col("id"), F.col("vec"), nothing.alias("seed_score"), F.array().cast("array<binary>").alias("seed_key"),
            nothing.alias("seed_id")]
    home = F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int")
    others = candidates.select("shard", "number", *bare)
    first = materialize(_searched(others.union(queries.select(home.alias("shard"), "number", *bare)), k))
    found = first
    if shards > 1:
        held = first.groupBy("number").agg(F.sort_array(F.collect_list(
            F.struct((-F.col("score")).alias("s"), "key", "id"))).alias("t"))
        seeded = queries.join(held.withColumnRenamed("number", "n"), F.col("number") == F.col("n"), "left").select(
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)).alias("shard"), "number", "id", "vec",
            F.transform("t", lambda x: -x["s"]).alias("seed_score"), F.col("t.key").alias("seed_key"), F.col("t.id").alias("seed_id"))
        found = first.union(_searched(others.union(seeded), k))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "key", "id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
                 .join(queries.select(F.col("number").alias("n"), F.col("id").alias("query_id")), F.col("number") == F.col("n"))
                 .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
