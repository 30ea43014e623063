"""Ranked lexical search by the Best Position Algorithm.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  One pass over the texts
keeps, per document, its number of terms and the frequencies of the terms that some query asks for.  From
these come the corpus statistics (documents with a term, all terms, documents per term) and integer impacts.
Documents are then searched in shards of ``SHARD`` rows.  A shard holds a list per term, its postings by falling impact;
a query reads its lists side by side, looks every document met up in all other lists, and marks the
positions so seen.  A list's best position is the last of its seen run from the top; the impacts there, summed, bound
every document not met, and the search stops when that bound is strictly below the query's k-th score (so no tie is
missed).  Positions are read in steps that double.  A task carries a query's k-th score from shard to shard and
returns k rows per query; ranking them is a window over those.

Queries go to the tasks in blocks of at most ``QUERY_BYTES`` of text (a longer one alone), each
block a search over all documents; nothing else is broadcast but the block's statistics.

Defined results: null and empty texts have no term: such documents count nowhere and are never found, such queries find
nothing.  Equal scores go by ascending id (a null id last).  A repeated document row is found once per row; a repeated
query row is answered once per row.  Empty tables give an empty result.  Very long texts are counted
whole.  Other columns are not read and not returned.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quadrant.llm.common import narrow
from quadrant.session import checkpoint_dir

SHARD = 8192             # documents searched together
QUERY_BYTES = 4 << 20    # text of the queries sent to tasks at once
STEP = 16                # positions of each list read first; doubled every round
# Everything but 0-9, A-Z, a-z and bytes beyond ASCII separates terms.
_LOWERED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
                 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return (text or b"").translate(_LOWERED).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight: falls with the documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's length factor, in hundredths; in Python integers where a long could overflow."""
    if 75 * documents * int(lengths.max(initial=0)) >= 1 << 63:
        return np.array([25 + 75 * int(n) * documents // total for n in lengths], np.int64)
    return 25 + 75 * lengths * documents // total


class Shard:
    """Impact lists of some documents: per term, postings by falling impact, and by document."""

    def __init__(self, ids: list, lengths: list[int], found: list[list[int]], counts: list[list[int]],
                 weights: np.ndarray, documents: int, total: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), [len(f) for f in found])
        term = np.fromiter((t for f in found for t in f), np.int64, len(doc))
        tf = np.fromiter((c for f in counts for c in f), np.int64, len(doc))
        norm = length_norms(np.asarray(lengths, np.int64), documents, total)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.by_doc = np.lexsort((self.doc, term))  # positions in document order, list by list
        self.docs_sorted = self.doc[self.by_doc]

    def search(self, query: dict[int, int], k: int, floor: int, step: int = STEP) -> list[tuple[int, int]]:
        """(score, row) of every document that can be among the k best, if it scores at least ``floor``.
        ``query``: times each term is asked for; ``step``: positions read first."""
        lists = [(t, n) for t, n in query.items() if self.first[t] < self.first[t + 1]]
        if not lists:
            return []
        begin = np.array([self.first[t] for t, _ in lists])
        size = np.array([self.first[t + 1] for t, _ in lists]) - begin
        times = np.array([n for _, n in lists])
        seen = [np.zeros(n + 1, bool) for n in size]  # the last never becomes true
        best = np.zeros(len(lists), np.int64)         # length of the seen run
        met = np.zeros(len(self.ids), bool)
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        read, kth = 0, floor
        while True:
            new = np.unique(np.concatenate([self.doc[b + read:b + min(read + step, n)] for b, n in zip(begin, size)
                                            if read < n] or [np.zeros(0, np.int64)]))
            new = new[~met[new]]
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for i, (b, n, q) in enumerate(zip(begin, size, times)):  # direct accesses
                own = self.docs_sorted[b:b + n]
                at = np.searchsorted(own, new)
                hit = np.flatnonzero(own[np.minimum(at, n - 1)] == new)
                position = self.by_doc[b + at[hit]]
                score[hit] += q * self.impact[position]
                seen[i][position - b] = True
                best[i] += int(seen[i][best[i]:].argmin())
            rows.append(new)
            scores.append(score)
            read, step = read + step, 2 * step
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = max(kth, int(np.partition(every, len(every) - k)[len(every) - k]))
            # the impact at each best position; a list seen to its end has nothing left
            bound = int(np.sum(np.where(best < size, times * self.impact[begin + np.maximum(best, 1) - 1], 0)))
            if bound < kth or bound == 0:
                break
        every, rows = np.concatenate(scores), np.concatenate(rows)
        keep = np.flatnonzero((every >= kth) & (every > 0))
        return list(zip(every[keep].tolist(), rows[keep].tolist()))


def _order(entry: tuple) -> tuple:
    """Highest score first, then the smallest id, a null one last."""
    score, doc_id = entry
    return -score, doc_id is None, doc_id if doc_id is not None else 0


def _query_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The queries (id, text) in blocks of bounded text."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.text or b"") > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row.id, bytes(row.text or b"")))
        size += len(row.text or b"") + 8
    if block:
        yield block


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n, found, counts: a row per document that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            keep, lengths, found, counts = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = terms(text)
                if own:
                    tf = Counter(own)
                    hits = sorted((asked[t], c) for t, c in tf.items() if t in asked)
                    keep.append(k)
                    lengths.append(len(own))
                    found.append([t for t, _ in hits])
                    counts.append([c for _, c in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "found", "counts"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, found array<int>, counts array<long>")


def _searched(postings: DataFrame, queries: list[tuple], asked: list[dict[int, int]], weights: np.ndarray,
              documents: int, total: int, k: int, item_kind: DataType) -> DataFrame:
    """query, item_id, doc_id, score: the k best of each task's documents."""
    sent = postings.sparkSession.sparkContext.broadcast(([q for q, _ in queries], asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, w = sent.value
        top: list[list] = [[] for _ in names]
        for shard in _shards(batches, SHARD):
            lists = Shard(*shard, w, documents, total)
            for i, query in enumerate(own):
                floor = top[i][-1][0] if len(top[i]) == k else 1
                best = [(s, lists.ids[r]) for s, r in lists.search(query, k, floor, STEP)]
                if best:
                    top[i] = sorted(top[i] + best, key=_order)[:k]
        rows = [(i, names[i], d, s) for i, best in enumerate(top) for s, d in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)],
            names=["query", "item_id", "doc_id", "score"])

    doc_kind = postings.schema["id"].dataType
    kinds = [pa.int32(), to_arrow_type(item_kind), to_arrow_type(doc_kind), pa.int64()]
    return postings.mapInArrow(run, f"query int, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long")


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list, list, list, list]]:
    """The rows of a partition, so many at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == rows:
                yield tuple(pa.Table.from_batches(held).to_pydict().values())
                held, size = [], 0
    if size:
        yield tuple(pa.Table.from_batches(held).to_pydict().values())


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item."""
    spark = docs.sparkSession
    given = narrow(docs, id=doc_id, text=text).withColumn("text", F.col("text").cast("binary"))
    asked_for = narrow(items, id=item_id, text=item_text).withColumn("text", F.col("text").cast("binary"))
    folder = f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    item_kind, doc_kind = (d.schema["id"].dataType for d in (asked_for, given))
    result = spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    for number, block in enumerate(_query_blocks(asked_for)):
        wanted = [Counter(terms(t)) for _, t in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        _counted(given, vocabulary).write.parquet(f"{folder}/{number}")
        postings = spark.read.parquet(f"{folder}/{number}")
        documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("found").alias("term")).groupBy("term").count().toLocalIterator():
            weights[r.term] = weight(documents, r["count"])
        asked = [{vocabulary[t]: n for t, n in w.items()} for w in wanted]
        found = _searched(postings, block, asked, weights, documents, total, k, item_kind)
        ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        result = result.unionByName(found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
                                    .select("item_id", "rank", "doc_id", "score"))
    return result
