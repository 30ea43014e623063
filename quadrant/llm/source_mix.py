"""Mixing sources to target weights, in blocks of fixed length.

The words of each source lie on a line, its documents one after another, cut
into blocks of ``BLOCK`` words.  The mix is written in shards of slots; a slot
holds one block.

* Targets: sources, in code-point order, weigh as ``WEIGHTS`` repeats; a target stops
  at ``REPEATS`` times its source's size, and the excess goes to the others by weight.
* A source's share of all slots is its target in blocks of its mean length, and
  what is left under one block is one more slot or none, by a draw seeded with (seed, source), so that the
  words expected are the target, also of a source smaller than a block.
* A shard has ``SHARD`` slots.  Each slot draws its source by a seeded hash from the target shares, so a shard's
  source counts are one multinomial draw; the draw is an as-of join with the shares laid end to end.  A source's
  offset in a shard is the sum of its draws in the shards before (a prefix scan).
* Balancing: draws beyond a source's share leave their slots empty, and what a source was drawn too seldom fills
  shards after the last.  So every source comes to its share, and ``taken`` is the sum over the slots drawn and balanced.
* Slot j of a source maps to pass j / blocks and, by a pseudorandom permutation
  (seeded with source and pass; a Feistel network) of j mod blocks, to a block:
  a pass takes each block at most once, so nothing is taken more often than passes begin.
* Slots and documents' pieces are joined on (source, block).

``mixed_shards`` gives the mix itself, slot by slot; ``taken`` and ``mixed_documents`` add up over all shards.

A document's place on its line is a prefix sum in levels: documents are dealt by hash
into buckets, places inside a bucket come from a window over that bucket, sums of buckets are accumulated
inside groups of ``GROUP`` buckets, and sums of groups per source; no task sorts a source.

Defined results: a null text has size 0; a null source is a source of its own, the last;
a text without words is never taken; rows repeated with the same id, source and text
each have a place of their own; null ids are no obstacle; an empty table gives an empty
result; other columns are not read by ``taken`` and ``mixed_shards``, and carried along by ``mixed_documents``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import narrow
from quadrant.operators.scan import asof_join, prefix_scan
from quadrant.session import materialize

WEIGHTS, REPEATS = (5, 2, 1), 3
BLOCK = 64             # words in a block
SHARD = 1 << 16        # slots in an output shard
BUCKET = 256           # documents in a bucket of the prefix sum, on average
GROUP = 1024           # buckets of a source accumulated by one task
DRAW = 1 << 52         # resolution of the draw that settles a rest under one block
SEED = 20_25
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _line(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))


def _runs(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """One row per different (id, source, text): doc_id, line, key, size, copies.
    line is the source ('' for null, '=' before others)."""
    return (narrow(documents, doc_id=doc_id, text=text, source=source)
            .select("doc_id", _line("source").alias("line"),
                    F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), word_count("text").alias("size"))
            .groupBy("doc_id", "line", "key", "size").agg(F.count(F.lit(1)).alias("copies")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """line, number (from 0), weight, source_size, target; ``sizes`` has line and
    source_size.  Only sums come to the driver: it raises the level at which uncapped sources
    stand, until no further source is capped."""
    order = Window.orderBy(F.col("line") == "", "line")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = materialize(sizes.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
                          .withColumn("weight", weight.cast("double")))
    cap = F.lit(float(repeats)) * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    total, level, state = float(first["all"] or 0), 0.0, None
    if total:
        level = total / first["weight"]
        while True:
            capped = F.lit(level) * F.col("weight") >= cap
            row = sources.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("held"),
                              F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
            if not row["open"] or (row["held"], row["open"]) == state:
                break
            state = row["held"], row["open"]
            level = (total - row["held"]) / row["open"]
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def _placed(runs: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its place on its line, and the sources."""
    words = F.col("size") * F.col("copies")
    sources = targets(runs.groupBy("line").agg(F.sum(words).alias("source_size")), weights, repeats)
    buckets = max(1, math.ceil(runs.count() / BUCKET))
    dealt = runs.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    earlier = (Window.unboundedPreceding, -1)
    per_bucket = (dealt.groupBy("line", "bucket").agg(F.sum(words).alias("words"))
                       .withColumn("group", F.floor(F.col("bucket") / GROUP)))
    before = Window.partitionBy("line").orderBy("group").rowsBetween(*earlier)
    groups = (per_bucket.groupBy("line", "group").agg(F.sum("words").alias("words"))
                        .withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
                        .join(sources.select("line", "number", "source_size", "target"), "line"))
    among = Window.partitionBy("line", "group").orderBy("bucket").rowsBetween(*earlier)
    lines = (per_bucket.withColumn("among", F.coalesce(F.sum("words").over(among), F.lit(0)))
                       .join(groups, ["line", "group"])
                       .withColumn("before", F.col("base") + F.col("among")).drop("words", "group", "base", "among"))
    inside = (Window.partitionBy("line", "bucket").orderBy("key", "doc_id", "size")
                    .rowsBetween(*earlier))
    rows = (dealt.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
                 .join(lines, ["line", "bucket"])
                 .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
                 .withColumn("start", F.col("before") + F.col("within") + F.col("copy") * F.col("size")))
    return rows.select("doc_id", "line", "key", "copy", "number", "size", "source_size", "target", "start"), sources


def permuted(index: np.ndarray, n: int, seed: int, source: int, turn: int) -> np.ndarray:
    """The places of ``index`` (each below n) under a pseudorandom permutation of range(n)."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(np.random.SeedSequence([seed, source, turn, n])).integers(0, 2**63, 4, np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # walk each cycle until it is back below n
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """number, block, shard, slot, turn: what every slot of the mix holds.

    Spark estimates this table by the few sources it is made from; so that it is
    not broadcast on that estimate, join it with the ``merge`` hint."""
    counted = (sources.filter("source_size > 0 AND target > 0")
               .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
               .withColumn("turns", F.floor(F.col("target") / F.col("source_size")).cast("long"))
               .withColumn("rest", F.greatest(F.col("target") - F.col("turns") * F.col("source_size"), F.lit(0.0)))
               .withColumn("more", F.col("rest") * F.col("blocks") / F.col("source_size"))
               .withColumn("drawn", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(DRAW)) / DRAW < F.col("more") % 1)
               .withColumn("total", F.col("turns") * F.col("blocks") + F.floor("more") + F.col("drawn").cast("long")))
    counted = materialize(counted.select("number", "blocks", "total").filter("total > 0"))
    everything = counted.agg(F.sum("total")).first()[0] or 0
    shares = (prefix_scan(counted, "sum", "total", ["number"], "end")
              .withColumn("begin", F.col("end") - F.col("total")).drop("end"))

    # every slot of a shard draws its source: together, multinomial counts from the target shares
    places = counted.sparkSession.range(everything).select(
        F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(everything, 1))).alias("drawn"))
    drawn = asof_join(places, shares, [], "drawn", "begin", ["begin", "number", "blocks", "total"], strict=False)
    # a source's draws in the shards before, and those before in the shard: the slot's number within the source
    ranked = materialize(prefix_scan(drawn, "count", F.lit(1), ["shard", "slot"], "nth", by=["number"]))
    within = ranked.filter("nth <= total").select("number", "blocks", "shard", "slot", (F.col("nth") - 1).alias("j"))

    # balancing shards after the last: what sources were drawn less often than their totals
    owing = (counted.join(ranked.groupBy("number").agg(F.count("*").alias("had")), "number", "left")
             .withColumn("had", F.coalesce("had", F.lit(0))).filter("had < total").withColumn("owed", F.col("total") - F.col("had")))
    owed = (prefix_scan(owing, "sum", "owed", ["number"], "upto")
            .withColumn("j", F.explode(F.sequence(F.col("had"), F.col("total") - 1)))
            .withColumn("place", F.col("upto") - F.col("total") + F.col("j")))
    after = math.ceil(everything / shard)
    balancing = owed.select("number", "blocks", (F.floor(F.col("place") / shard) + after).alias("shard"),
                            (F.col("place") % shard).alias("slot"), "j")
    names = ["number", "block", "shard", "slot", "turn"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, blocks, of, slot, j = (c.to_numpy() for c in batch.columns)
            turn, place = j // blocks, np.zeros(len(j), np.int64)
            order = np.lexsort((turn, number))
            edges = np.flatnonzero(np.diff(number[order], prepend=-1).astype(bool) | np.diff(turn[order], prepend=-1).astype(bool))
            for own in np.split(order, edges[1:]) if len(order) else []:
                n, size, t = int(number[own[0]]), int(blocks[own[0]]), int(turn[own[0]])
                place[own] = permuted(j[own] % size, size, seed, n, t)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (number, place, of, slot, turn)], names)

    return within.unionByName(balancing).mapInArrow(run, schema)


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The part that each row has of each block: its words first..last-1."""
    end = F.col("start") + F.col("size")
    return (rows.filter("size > 0")
                .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
                .withColumn("first", F.greatest(F.col("block") * block, "start") - F.col("start"))
                .withColumn("last", F.least((F.col("block") + 1) * block, end) - F.col("start")))


def taken(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK,
          shard: int = SHARD, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes) of every row."""
    rows, sources = _placed(materialize(_runs(documents, doc_id, text, source)), weights, repeats)
    times = slots(sources, block, shard, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    words = (_pieces(rows, block).join(times.hint("merge"), ["number", "block"])
             .groupBy(F.col("number").alias("n"), F.col("start").alias("s"))
             .agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken")))
    here = F.when(F.col("size") > 0, F.col("start"))
    return (rows.join(words, (F.col("number") == F.col("n")) & (here == F.col("s")), "left")
                .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))


def cut(text: str, parts: list[tuple[int, int]]) -> str:
    """The words of the parts, in order, as they stand in the text; parts that do
    not touch go on a new line."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for first, last in sorted(parts):
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in runs)


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS,
                    block: int = BLOCK, shard: int = SHARD, seed: int = SEED, doc_id: str = "doc_id",
                    text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of
    it, with those words as text and their length, other columns unchanged."""
    rows, sources = _placed(materialize(_runs(documents, doc_id, text, source)), weights, repeats)
    part = F.struct(F.col("first"), F.col("last"))
    takes = (_pieces(rows, block).join(slots(sources, block, shard, seed).hint("merge"), ["number", "block"])
             .groupBy("key", "doc_id", "line", "copy", "turn").agg(F.collect_list(part).alias("parts"))
             .groupBy(F.col("key").alias("__mix_k"), F.col("doc_id").alias("__mix_d"), F.col("line").alias("__mix_l"))
             .agg(F.collect_list(F.struct("copy", "parts")).alias("__mix_all")))
    mine = ["__mix_key", "__mix_takes", "__mix_parts", "__mix_line"]
    keyed = (documents.withColumn(mine[0], F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
             .withColumn(mine[3], _line(source)))
    # equal rows are numbered by all their columns, so a task that runs again numbers them alike
    told = [F.col(f"`{f.name}`") for f in documents.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    copy = F.row_number().over(Window.partitionBy(mine[0], F.col(f"`{doc_id}`"), mine[3]).orderBy(*told)) - 1
    joined = (keyed.join(takes, (F.col(mine[0]) == F.col("__mix_k")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__mix_d"))
                         & (F.col(mine[3]) == F.col("__mix_l")))
              .withColumn(mine[0], copy)
              .withColumn(mine[1], F.filter("__mix_all", lambda t: t["copy"] == F.col(mine[0])))
              .withColumn(mine[2], F.explode(F.col(f"{mine[1]}.parts"))))
    names = documents.columns
    out = joined.select(*[F.col(f"`{c}`") for c in names], mine[2])
    at, size_at = names.index(text), names.index(length) if length in names else None
    schema = T.StructType([documents.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(names)).to_pylist()
            texts = [cut(t, [(p["first"], p["last"]) for p in ps])
                     for t, ps in zip(batch.column(at).to_pylist(), parts, strict=True)]
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            if size_at is not None:
                columns[size_at] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return out.mapInArrow(run, schema)


def mixed_shards(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS,
                 block: int = BLOCK, shard: int = SHARD, seed: int = SEED, doc_id: str = "doc_id",
                 text: str = "text", source: str = "source") -> DataFrame:
    """shard, slot, source, text: the mix as its shards, a row a slot, with the words of the
    slot's block; parts of different rows are on lines of their own.  A slot is a place in its
    shard; the places of draws beyond a source's share are missing."""
    rows, sources = _placed(materialize(_runs(documents, doc_id, text, source)), weights, repeats)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    texts = (narrow(documents, doc_id=doc_id, text=text, source=source)
             .groupBy(F.col("doc_id").alias("d"), _line("source").alias("l"), key.alias("k")).agg(F.first("text").alias("text")))
    placed = (rows.filter("size > 0")
              .join(texts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")))
              .select("number", "start", "text"))
    names = ["number", "block", "start", "part"]
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names[:3]), T.StructField("part", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start, whole in zip(*batch.columns, strict=True):
                number, start, whole = number.as_py(), start.as_py(), whole.as_py()
                spans = [m.span() for m in re.finditer(WORD, whole)]
                edges = [0, *range(block - start % block, len(spans), block), len(spans)]
                parts = [whole[spans[a][0]:spans[b - 1][1]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                held = [(number, start // block + k, start, part) for k, part in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    parts = F.sort_array(F.collect_list(F.struct("start", "part")))
    blocks = (placed.mapInArrow(run, schema).groupBy("number", "block")
              .agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text")))
    named = sources.select("number", F.when(F.col("line") != "", F.substring("line", 2, 2**31 - 1)).alias("source"))
    return (blocks.join(slots(sources, block, shard, seed).hint("merge"), ["number", "block"]).join(named, "number")
                  .select("shard", "slot", "source", "text"))
