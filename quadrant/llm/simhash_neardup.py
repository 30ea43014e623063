"""SimHash near-duplicates by pigeonhole blocks.

1. Every text gets a 64-bit fingerprint of its word shingles' XXH64 hashes.
2. Equal fingerprints are one node from here on (a group-by that pre-aggregates),
   so copies, however many, cost one row.
3. Fingerprints are split into ``distance + 2`` blocks: two that differ in at most
   ``distance`` bits agree in two blocks at least.  Each fingerprint is dealt out under every pair
   of its blocks, and the fingerprints that meet there are compared by their Hamming distance.
   A bucket is not expanded into its pairs: the task that compares it gives the stars
   of its connected parts, at most a row a fingerprint.  A bucket beyond
   ``CELL`` fingerprints is cut into chunks by hash, and every two chunks meet in a cell of
   their own, in different tasks; so no link is lost and no bucket is
   too large for a task.
4. The stars are merged to connected components.

Defined results: null and blank texts have fingerprint zero, and are linked like others; a
component's id is the smallest non-null id in it (null if it has none); rows repeated
under one id are each reported; an empty table gives an empty result;
columns not named are not read by ``near_duplicates``, and carried along by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import narrow
from quadrant.llm.components import connected_components
from quadrant.session import materialize

CELL = 1024          # fingerprints of a bucket compared by one task without splitting it
HASHED = 1 << 16     # shingles whose bits are counted at a time
HELD = 1 << 18       # rows of buckets compared at a time
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHED):
        cut = zip(starts[at:at + HASHED].tolist(), ends[at:at + HASHED].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in cut], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def _dealt(nodes: DataFrame, distance: int) -> DataFrame:
    """(combo, key, fp): each fingerprint under every pair of its blocks."""
    n = distance + 2
    edge = [round(64 * i / n) for i in range(n + 1)]

    def block(i):
        return F.shiftrightunsigned("fp", edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1))

    keys = [F.struct(F.lit(k).alias("combo"),
                     (F.shiftleft(block(i), edge[j + 1] - edge[j]) + block(j)).alias("key"))
            for k, (i, j) in enumerate(combinations(range(n), 2))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("b")).select("b.combo", "b.key", "fp")


def _cells(dealt: DataFrame, cell: int) -> DataFrame:
    """Large buckets cut into chunks; every two chunks of one share a cell."""
    large = (dealt.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
                  .select(F.col("combo").alias("c"), F.col("key").alias("k"),
                          F.ceil(F.col("n") / F.lit(cell // 2)).cast("long").alias("chunks")))
    rows = dealt.join(large, (F.col("combo") == F.col("c")) & (F.col("key") == F.col("k")), "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
                         lambda o: F.least(o, F.col("mine")) * F.col("chunks") + F.greatest(o, F.col("mine")))
    return (rows.withColumn("mine", mine)
                .select("combo", "key", "fp", F.explode(F.coalesce(others, F.array(F.lit(-1).cast("long")))).alias("cell")))


def _links(cells: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) that join what each cell's links connect."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    dealt = cells.repartition("combo", "key", "cell").sortWithinPartitions("combo", "key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([np.asarray(batch.column(k)) for k in (0, 1, 2, 3)])
            rows += batch.num_rows
            if rows >= HELD:
                combo, key, fp, cell = map(np.concatenate, zip(*held, strict=True))
                change = (combo[1:] != combo[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
                last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
                yield _stars(combo[:last], key[:last], cell[:last], fp[:last], distance)
                held, rows = [[combo[last:], key[last:], fp[last:], cell[last:]]], len(fp) - last
        if held:
            combo, key, fp, cell = map(np.concatenate, zip(*held, strict=True))
            yield _stars(combo, key, cell, fp, distance)

    return dealt.select("combo", "key", "fp", "cell").mapInArrow(run, schema)


def _stars(combo: np.ndarray, key: np.ndarray, cell: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    """Compare all pairs inside each cell; link each fingerprint to its part's first."""
    bits, label = fp.view(np.uint64), np.arange(len(fp))
    same = np.ones(len(fp), bool)
    if len(fp):
        same[1:] = (combo[1:] == combo[:-1]) & (key[1:] == key[:-1]) & (cell[1:] == cell[:-1])
        same[0] = False
    group = np.cumsum(~same)
    left = np.flatnonzero(np.r_[group[1:] == group[:-1], False]) if len(fp) else np.zeros(0, np.int64)
    shift = 1
    while len(left):  # each row with the shift-th row after it, while that is in its cell
        near = left[np.bitwise_count(bits[left] ^ bits[left + shift]) <= distance]
        if len(near):
            _unite(label, near, near + shift)
        shift += 1
        left = left[left + shift < len(fp)]
        left = left[group[left] == group[left + shift]]
    at = np.arange(len(fp))
    while True:
        up = label[label]
        if np.array_equal(up, label):
            break
        label = up
    moved = np.flatnonzero((label != at) & (fp != fp[label]))
    return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["u", "v"])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the roots of linked rows to each other until they agree."""
    while len(a):
        ra, rb = _roots(label, a), _roots(label, b)
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def _roots(label: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = label[at]
    while True:
        up = label[root]
        if np.array_equal(up, root):
            break
        root = up
    label[at] = root
    return root


def _components(rows: DataFrame, distance: int, cell: int) -> DataFrame:
    """node, least, root, component_id of every fingerprint: the smallest id that carries it, the
    fingerprint that stands for its component, and the smallest id in that component."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = _links(_cells(_dealt(nodes, distance), cell), distance)
    labels = connected_components(links)
    linked = nodes.join(labels, nodes["fp"] == labels["node"])
    roots = linked.groupBy(F.col("label").alias("root")).agg(F.min("least").alias("component"))
    linked = linked.join(roots, F.col("label") == F.col("root")).select(F.col("fp").alias("node"), "root", "component")
    # Cut here, so that both sides of the last join are plain shuffles and a fingerprint that
    # very many rows carry is split by the skew-join handling.
    return materialize(nodes.join(linked, F.col("fp") == F.col("node"), "left")
                       .select(F.col("fp").alias("node"), "least", F.coalesce("root", "fp").alias("root"),
                               F.coalesce("component", "least").alias("component_id")))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    rows = materialize(fingerprints(documents, doc_id, text, shingle))
    ids = _components(rows, distance, cell).select("node", "component_id")
    return (rows.join(ids, F.col("fp") == F.col("node"))
                .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                distance: int = 3) -> DataFrame:
    """One document of each component, with all its columns: one whose id names the component
    (one without an id, if all its ids are null).  A component is known by its root fingerprint, so
    null ids, and an id on texts that are not linked, leave a document in each component; of
    rows with the surviving id and fingerprint one is left."""
    rows = materialize(fingerprints(documents, doc_id, text, shingle))
    mine, kept = ["__near_dup_id", "__near_dup_fp"], ["__near_dup_kept_id", "__near_dup_kept_fp"]
    stay = (_components(rows, distance, CELL).filter(F.col("least").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min("component_id").alias(kept[0]), F.min("node").alias(kept[1])).drop("root"))

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    # Null-safe, so that no filter on the fingerprint is inferred that would compute it once more.
    marked = documents.withColumns({mine[0]: F.col(f"`{doc_id}`"), mine[1]: bits(F.col(f"`{text}`"))})
    found = marked.join(stay, F.col(mine[0]).eqNullSafe(F.col(kept[0])) & F.col(mine[1]).eqNullSafe(F.col(kept[1])), "left_semi")
    return found.dropDuplicates(mine).drop(*mine)
