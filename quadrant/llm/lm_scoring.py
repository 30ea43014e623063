"""Language-model scores of texts by context-tree weighting over bytes.

A byte is eight binary decisions, from its highest bit.  Every node (the ``depth`` or fewer bytes before, the
bits of the byte known so far) counts the zeros and ones that followed in training.  A node's
weighted probability is half its Krichevsky-Trofimov estimate and half the product of its children's, the nodes
with one more byte of context; a prediction mixes the estimates of all depths by the weights
that training left on its path.  The model's log10 probability of a text is the sum over its bytes, A-Z
lower-cased, and an end symbol (0xFF, which UTF-8 never holds); before a text stand ``depth`` zero bytes.

How it runs: texts are dealt into blocks of about ``BLOCK`` bytes and stored, packed.  Each block reports its different
grams (context and byte) and words with their training counts, zero for held-out texts, so the tree has a path
for all that will be asked.  Counts are summed by Spark.  Grams that share their last two context
bytes are one subtree (at most 2^24 grams at depth 4, whatever the corpus): every subtree is weighted in one task, up for
block probabilities and, after the two top levels (at most 65,280 nodes) are done on the driver, down for the price
of each gram.  Prices go back to the blocks that hold the gram, by a join, and counts of words to the
blocks whose own count is not all there is; each block adds up its texts.  Nothing is cut off: tables of grams and words grow with the corpus.

Beside it stands the base score: words and one end per text, priced by smoothed counts of training tokens.

Defined results: a null text is empty (one end); repeated rows are trained on and scored each; a null id is
an ordinary row; without training rows every bit is an even chance and the base score 0; an empty table gives an empty
result.  A very long text is a block of its own.  Bytes that are no UTF-8 are bytes like others.  Other columns
are not read and not returned.  Sums of doubles may differ in their last digits between runs.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrant.llm.common import narrow
from quadrant.session import checkpoint_dir

DEPTH = 4               # bytes of context
BLOCK = 10 << 20        # bytes of text priced together
FLAT = 1 << 20          # bytes of a block packed and worked on at once
SUBTREE_ROWS = 1 << 18  # grams of whole subtrees worked on at once
END = b"\xff"
LOG_HALF = math.log(0.5)


# ---- grams and words of texts --------------------------------------------------

def _flat(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' grams one after the other, and where each text's begin and end.  A gram holds
    the latest byte of context highest, then older ones, and the predicted byte lowest."""
    pad = b"\0" * 8
    data = b"".join(part for t in texts for part in (pad, t, END))
    # at every place the eight bytes before it, as one number: the latest is the highest
    before = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
    grams = before >> np.uint64(64 - 8 * depth)
    grams <<= np.uint64(8)
    grams |= np.frombuffer(data, np.uint8, offset=8)
    ends = np.cumsum([len(t) + 9 for t in texts])
    return grams, ends - [len(t) + 9 for t in texts], ends - 8


def _tallied(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different grams in order, with their number of places (or the sum of weights)."""
    if weights is not None:
        order = np.argsort(grams, kind="stable")
        grams, weights = grams[order], weights[order]
    else:
        grams = np.sort(grams)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    if weights is not None:
        return grams[first], np.add.reduceat(weights, first)
    return grams[first], np.diff(np.append(first, len(grams)))


def _piece_grams(texts: list[bytes], trains: list[bool], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different grams of a piece's training texts with their counts, and of its other texts with zeros."""
    for wanted in (True, False):
        own = [t for t, x in zip(texts, trains) if x is wanted]
        if own:
            grams, begins, ends = _flat(own, depth)
            inside = np.zeros(len(grams) + 1, np.int8)
            inside[begins] += 1
            inside[ends] -= 1
            keys, n = _tallied(grams[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
            yield keys, n if wanted else np.zeros(len(keys), np.int64)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _tallied(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def _count_words(words: Counter, texts: list[bytes], trains: list[bool]) -> None:
    """Add a piece's words, with their number in training texts; b'' is the end."""
    for t, own in zip(texts, trains):
        if own:
            words.update(t.split())
            words[b""] += 1
        else:
            for w in t.split():
                words.setdefault(w, 0)
            words.setdefault(b"", 0)


# ---- the weighted tree ---------------------------------------------------------

_HALVES = np.array([math.lgamma(k + 0.5) for k in range(64)])
_WHOLES = np.array([math.lgamma(k + 1) for k in range(64)])


def _lgamma(x: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(x + shift) of counts: a table for small ones, Stirling's series beyond."""
    z = np.maximum(x, 32) + shift
    series = ((z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5))
    return np.where(x < 32, table[np.minimum(x, 32).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    return (_lgamma(zeros, _HALVES, 0.5) + _lgamma(ones, _HALVES, 0.5)
            - _lgamma(zeros + ones, _WHOLES, 1.0) - math.log(math.pi))


def _weigh(zeros, ones, children):
    """Log weighted probability of inner nodes, and the share of their own estimate in it."""
    stop, go = LOG_HALF + log_kt(zeros, ones), LOG_HALF + children
    weighted = np.logaddexp(stop, go)
    return weighted, np.exp(stop - weighted)


def _up(keys: np.ndarray, n: np.ndarray, plane: int, depth: int) -> list[dict]:
    """The levels of the subtrees for one bit of the byte, from ``depth`` to 2.  ``keys``: sorted
    different grams.  A node is its context, latest byte highest, and below that the bits known."""
    n = n.astype(np.float64)
    node = keys >> np.uint64(8 - plane)
    bit = ((keys >> np.uint64(7 - plane)) & np.uint64(1)).astype(np.float64)
    new = np.concatenate([[True], node[1:] != node[:-1]])
    first = np.flatnonzero(new)
    zeros, ones = np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)
    level = {"node": node[first], "inside": np.cumsum(new) - 1, "zeros": zeros, "ones": ones,
             "weighted": log_kt(zeros, ones), "share": np.ones(len(first))}
    levels = [level]
    low = np.uint64((1 << plane) - 1)
    for _ in range(depth - 2):
        parent = (level["node"] >> np.uint64(plane + 8) << np.uint64(plane)) | (level["node"] & low)
        node, level["parent"] = np.unique(parent, return_inverse=True)
        zeros, ones, children = (np.bincount(level["parent"], level[c], len(node))
                                 for c in ("zeros", "ones", "weighted"))
        weighted, share = _weigh(zeros, ones, children)
        level = {"node": node, "zeros": zeros, "ones": ones, "weighted": weighted, "share": share}
        levels.append(level)
    return levels


def _top(node: np.ndarray, plane: int) -> np.ndarray:
    """Where a depth-2 node's parent stands in the (8, 256, 128) arrays of depth 1, flat."""
    latest, known = node >> np.uint64(plane + 8), node & np.uint64((1 << plane) - 1)
    return (np.uint64(plane * 256) + latest) * np.uint64(128) + known


def _down(levels: list[dict], start: np.ndarray, plane: int) -> np.ndarray:
    """Probability of a one for every gram's node: estimates of all depths mixed by their shares,
    continuing ``start`` (mass mixed so far for zero and for one, and what is left, per depth-1 node).
    Returned for both bits, so that none is a difference of near equals."""
    zero, one, left = start[:, _top(levels[-1]["node"], plane).astype(np.int64)]
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        total = level["zeros"] + level["ones"] + 1
        mixed = left * level["share"]
        zero, one = zero + mixed * (level["zeros"] + 0.5) / total, one + mixed * (level["ones"] + 0.5) / total
        left = left - mixed
        if k:
            own = levels[k - 1]["parent"]
            zero, one, left = zero[own], one[own], left[own]
    own = levels[0]["inside"]
    return np.stack([zero[own], one[own]])


def _subtrees(batches: Iterator[pa.RecordBatch], depth: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole subtrees of a partition, some at a time: sorted grams and counts."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    keys, n = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    tree = keys >> np.uint64(8 * (depth - 1))
    borders = np.append(np.flatnonzero(tree[1:] != tree[:-1]) + 1, len(keys))
    begin = 0
    while begin < len(keys):
        end = borders[min(np.searchsorted(borders, begin + rows), len(borders) - 1)]
        yield keys[begin:end], n[begin:end]
        begin = end


def _tops(counts: DataFrame, depth: int) -> np.ndarray:
    """What the two top levels mix: for every depth-1 node the mass for zero, for one, and what is
    left for its children.  The sums that come to the driver are at most 65,280 rows."""

    def run(batches):
        sums = np.zeros((3, 8 * 256 * 128))
        for keys, n in _subtrees(batches, depth, SUBTREE_ROWS):
            for plane in range(8):
                level = _up(keys, n, plane, depth)[-1]
                at = _top(level["node"], plane).astype(np.int64)
                for k, c in enumerate(("zeros", "ones", "weighted")):
                    sums[k] += np.bincount(at, level[c], sums.shape[1])
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(s[at]) for s in sums]],
                                         names=["node", "zeros", "ones", "weighted"])

    found = (counts.mapInArrow(run, "node long, zeros double, ones double, weighted double")
             .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).collect())
    sums = np.zeros((3, 8 * 256 * 128))
    for r in found:
        sums[:, r.node] = r.zeros, r.ones, r.weighted
    weighted, share = _weigh(*sums)
    zeros, ones = (s.reshape(8, 256, 128).sum(axis=1) for s in sums[:2])
    _, share0 = _weigh(zeros, ones, weighted.reshape(8, 256, 128).sum(axis=1))
    share0 = np.repeat(share0[:, None], 256, axis=1).ravel()
    root = [np.repeat(((c + 0.5) / (zeros + ones + 1))[:, None], 256, axis=1).ravel() for c in (zeros, ones)]
    total = sums[0] + sums[1] + 1
    mixed = (1 - share0) * share
    return np.stack([share0 * root[0] + mixed * (sums[0] + 0.5) / total,
                     share0 * root[1] + mixed * (sums[1] + 0.5) / total, (1 - share0) * (1 - share)])


def _prices(counts: DataFrame, start: np.ndarray, depth: int) -> DataFrame:
    """gram, value: log10 probability of the gram's byte after its context."""

    def run(batches):
        for keys, n in _subtrees(batches, depth, SUBTREE_ROWS):
            value = np.zeros(len(keys))
            for plane in range(8):
                both = _down(_up(keys, n, plane, depth), start, plane)
                bit = ((keys >> np.uint64(7 - plane)) & np.uint64(1)).astype(np.int64)
                value += np.log10(both[bit, np.arange(len(keys))])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(value)],
                                             names=["gram", "value"])

    return counts.mapInArrow(run, "gram long, value double")


# ---- jobs ----------------------------------------------------------------------

def _packed(docs: DataFrame) -> DataFrame:
    """Pieces of about ``FLAT`` bytes of texts, lower-cased and compressed, with the block they belong to."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        block, filled = TaskContext.get().partitionId() << 33, 0
        ids, trains, texts, size = [], [], [], 0
        names = ["block", "ids", "trains", "lengths", "texts"]

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([trains], pa.list_(pa.bool_())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack(b"".join(texts))], pa.binary())],
                names=names)

        for batch in batches:
            for i, own, t in zip(*[batch.column(c).to_pylist() for c in ("id", "trains", "text")]):
                ids.append(i)
                trains.append(own)
                texts.append(t.lower())
                size += len(t) + 1
                if size >= FLAT:
                    yield piece()
                    filled += size
                    ids, trains, texts, size = [], [], [], 0
                    if filled >= BLOCK:
                        block, filled = block + 1, 0
        if ids:
            yield piece()

    kind = docs.schema["id"].dataType
    id_type = to_arrow_type(kind)
    return docs.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, trains array<boolean>, lengths array<long>, texts binary")


def _unpacked(blob: bytes, lengths: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, sum(lengths)))
    ends = np.cumsum(lengths).tolist()
    return [data[e - n:e] for e, n in zip(ends, lengths)]


def _seen(packed: DataFrame, depth: int) -> DataFrame:
    """block, gram or word, n: what each block holds, with its number in training texts."""

    def report(block, grams, words):
        keys, n = _merged(grams)
        size = len(keys) + len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, block)),
             pa.concat_arrays([pa.array(keys.astype(np.int64)), pa.nulls(len(words), pa.int64())]),
             pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array(list(words), pa.binary())]),
             pa.concat_arrays([pa.array(n, pa.int64()), pa.array(list(words.values()), pa.int64())])],
            names=["block", "gram", "word", "n"])

    def run(batches):
        block, grams, words = None, [], Counter()
        for batch in batches:
            for b, trains, lengths, blob in zip(*[batch.column(c).to_pylist() for c in ("block", "trains", "lengths", "texts")]):
                if b != block and grams:
                    yield from report(block, grams, words)
                    grams, words = [], Counter()
                block = b
                texts = _unpacked(blob, lengths)
                grams += _piece_grams(texts, trains, depth)
                _count_words(words, texts, trains)
        if grams:
            yield from report(block, grams, words)

    return packed.drop("ids").mapInArrow(run, "block long, gram long, word binary, n long")


def score(docs: DataFrame, trains: Column, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """doc_id, trains, n_bytes, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row.

    ``trains`` is a condition on ``id`` that says which rows the model learns from.  ``depth`` is 2 to 6; a subtree has at
    most 256^(depth - 1) grams."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    given = narrow(docs, id=doc_id, text=text).select(
        "id", F.coalesce(trains, F.lit(False)).alias("trains"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    packed = kept(_packed(given), "texts")
    seen = kept(_seen(packed, depth), "seen")

    counts = kept(seen.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    counts = counts.repartition(F.shiftright("gram", 8 * (depth - 1)))  # a subtree stays together
    grams = _prices(counts, _tops(counts, depth), depth)

    # a word's rows are one a block at most; where a block holds all of a word, its own count is right
    of_word = Window.partitionBy("word")
    everywhere = seen.filter("word IS NOT NULL").select(
        "block", "word", "n", F.sum("n").over(of_word).alias("c"), F.row_number().over(of_word.orderBy("block")).alias("nth"))
    words = kept(everywhere.filter("c <> n OR nth = 1").select(
        "block", F.when(F.col("c") != F.col("n"), F.col("word")).alias("word"), "c",
        ((F.col("nth") == 1) & (F.col("c") > 0)).alias("known")), "words")
    total = seen.filter("word IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    below = total + 0.5 * (words.filter("known").count() + 1)
    unknown = math.log10(0.5 / below)

    blocks = (seen.filter("gram IS NOT NULL").select("block", "gram").join(grams, "gram")
              .select("block", "gram", F.lit(None).cast("binary").alias("word"), "value")
              .unionByName(words.filter("word IS NOT NULL").select(
                  "block", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value"))))

    def run(key, pieces: pa.Table, prices: pa.Table) -> pa.Table:
        is_gram = pc.is_valid(prices.column("gram"))
        own = prices.filter(is_gram)
        keys, values = own.column("gram").combine_chunks(), own.column("value").to_numpy()
        elsewhere = prices.filter(pc.invert(is_gram)).select(["word", "value"])
        del prices, own
        price, n_bytes, n_tokens, n_known, base, model = Counter(), [], [], [], [], []
        held = pieces.select(["trains", "lengths", "texts"]).to_pylist()
        for p in held:
            _count_words(price, _unpacked(p["texts"], p["lengths"]), p["trains"])
        for batch in elsewhere.to_batches(max_chunksize=1 << 14):
            for w, n in zip(batch.column("word").to_pylist(), batch.column("value").to_pylist()):
                price[w] = n
        by_count = {n: math.log10((n + 0.5) / below) for n in set(price.values())}
        for w, n in price.items():
            price[w] = by_count[n]
        for p in held:
            texts = _unpacked(p["texts"], p["lengths"])
            grams, begins, ends = _flat(texts, depth)
            at = pc.fill_null(pc.index_in(pa.array(grams.astype(np.int64)), value_set=keys), -1).to_numpy()
            value = np.append(np.where(at < 0, np.nan, values[at]), 0.0)  # between texts: not asked
            model += np.add.reduceat(value, np.stack([begins, ends], 1).ravel())[::2].tolist()
            n_bytes += p["lengths"]
            for t in texts:
                each = [price[w] for w in t.split()] + [price[b""]]
                n_tokens.append(len(each))
                n_known.append(len(each) - each.count(unknown))
                base.append(sum(each))
        return pa.table({"doc_id": pc.list_flatten(pieces.column("ids")), "trains": pc.list_flatten(pieces.column("trains")),
                         "n_bytes": pa.array(n_bytes, pa.int64()),
                         "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64())})

    kind = given.schema["id"].dataType.simpleString()
    scored = (packed.groupBy("block").cogroup(blocks.groupBy("block"))
              .applyInArrow(run, f"doc_id {kind}, trains boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"))
    return (scored.withColumn("train_tokens", F.lit(int(total)))
            .withColumn("bits_per_byte", -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)))
