"""Fill-in-the-middle transformation with a learned rank index over line ends.

A text is cut into lines; two pseudorandom ranks per document, drawn from a hash of its id, say
after how many lines the prefix and the middle end.  The byte offset of a rank comes from
``RankIndex``: the offsets of all line ends of a batch of texts, in order, are covered by straight segments,
each the longest whose error stays within ``ERROR`` bytes (a cone of slopes narrowed from its first
point); what a segment's prediction misses is stored per rank, so a predicted cut plus its residual is exact.

The output is ``plain`` (the text), ``psm`` (<P>prefix<S>suffix<M>middle) or ``spm``
(<S>suffix<P>prefix<M>middle).  ``restored`` takes output and form apart again.

Defined results: a null text is empty; an empty text, or one that holds a marker, stays plain with null
lengths; a text without line ends is one line (its prefix and middle may be empty or all of it).  A null id
hashes as ''.  Repeated rows give equal rows, an empty table an empty result; very long texts are
one row of a batch (the index is per batch, whose size Arrow bounds in rows).  Bytes that are no UTF-8 pass through.
Other columns are not read and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.llm.common import narrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # markers
ERROR = 512          # bytes that a segment may miss an offset by
FIRST_WINDOW = 128   # points tried first for a segment; doubled while they fit


class RankIndex:
    """Offsets by rank: ``select(r)`` is the r-th (from 0) of the sorted ``offsets`` given."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        offsets = np.asarray(offsets, np.int64)
        first, slopes = [], []
        at = 0
        while at < len(offsets):
            length, slope = _segment(offsets, at, error)
            first.append(at)
            slopes.append(slope)
            at += length
        self.size = len(offsets)
        self.first = np.asarray(first, np.int64)
        self.base = offsets[self.first] if len(first) else np.zeros(0, np.int64)
        self.slopes = np.asarray(slopes)
        residuals = offsets - self.predict(np.arange(len(offsets)))
        self.residuals = residuals.astype(np.int16 if error < 1 << 15 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """The offset that the rank's segment expects; within the error of the true one."""
        if not self.size:
            return np.zeros(len(ranks), np.int64)
        k = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[k] + np.rint(self.slopes[k] * (ranks - self.first[k])).astype(np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of ``ranks``."""
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def _segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """Points that one line from ``offsets[at]`` covers, and its slope.  The bound is
    narrowed by one byte for the rounding of predictions."""
    bound, window = error - 1, FIRST_WINDOW
    while True:
        rise = offsets[at + 1:at + 1 + window] - offsets[at]
        run = np.arange(1, len(rise) + 1)
        low = np.maximum.accumulate((rise - bound) / run)
        high = np.minimum.accumulate((rise + bound) / run)
        bad = low > high
        fits = int(bad.argmax()) if bad.any() else len(rise)
        if fits < len(rise) or at + 1 + len(rise) >= len(offsets):
            return fits + 1, float(low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0
        window *= 2


def line_ends(buffer: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets after every line of the texts that follow each other in ``buffer``; a text's end
    closes its last line."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.union1d(np.flatnonzero(buffer == 10) + 1, ends[ends > starts])


def _draws(key: str, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _arranged(texts: list[bytes], keys: list[str], seed: str, rate: int, spm_rate: int):
    """Of each text: lines, form, characters of prefix and of middle, output."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    boundaries = line_ends(buffer, ends)
    index = RankIndex(boundaries)
    base = np.searchsorted(boundaries, starts, "right")  # boundaries up to the text's start
    lines = np.searchsorted(boundaries, ends, "right") - base
    draws = np.array([_draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    one, two = draws[:, 0] % (lines + 1), draws[:, 1] % (lines + 1)
    cuts = []
    for units in (np.minimum(one, two), np.maximum(one, two)):
        at = starts.copy()
        some = units > 0
        at[some] = index.select(base[some] + units[some] - 1)
        cuts.append((at - starts).tolist())
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for t, n, (_, _, h3, h4), a, b in zip(texts, lines.tolist(), draws.tolist(), *cuts):
        if not t or h3 % 100 >= rate or any(m in t for m in markers):
            yield n, "plain", None, None, t
            continue
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        p, s, m = markers
        form = "spm" if h4 % 100 < spm_rate else "psm"
        output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        yield n, form, _characters(prefix), _characters(middle), output


def _characters(text: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int | str = 7,
              rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output for every row.

    ``rate`` percent of the documents are rearranged, ``spm_rate`` percent of them with the suffix first."""
    kind = docs.schema[doc_id].dataType
    given = narrow(docs, id=doc_id, text=text).select(
        "id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    seed = str(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _arranged(batch.column("text").to_pylist(), batch.column("key").to_pylist(), seed, rate, spm_rate)
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return given.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The original text.  Markers occur in an arranged output only where they were put."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
             .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
             .otherwise(output))
