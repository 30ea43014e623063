"""Quality classifier by compression with zstandard dictionaries.

Two dictionaries are trained, one on pieces of good and one on pieces of bad labelled texts.  A text is
cut into chunks of ``CHUNK`` bytes, and every chunk is compressed with either dictionary (short
chunks, so that the dictionary and not the text's own repetition decides).  Its
feature is the difference of the compressed sizes over the text's size: what the
good dictionary saves against the bad one per byte.  It becomes the probability of label 1
by isotonic regression on other labelled texts, weighted to the labels' real
proportion: a curve that rises with the feature, interpolated between its steps.  A
small part (``TILT``) of the score is a logistic curve, so that features on a
level stretch keep their order.

Learning reads at most about ``SAMPLE`` documents a class for the dictionaries, and as
many others for the calibration, chosen by a hash of their id (of several documents with one id the one with the smallest
text); of one document at most ``PIECES`` pieces, spread over the whole text: a bound of the training sample beside that on rows.  Only these pieces and the calibration's
features come to the driver; the dictionaries, of fixed size, go to the tasks.

Defined results: a null or empty text has feature 0 and gets that feature's score; a document
with several labels has their mean (half and half: none); null labels and ids are left
out of learning; with no label at all every score is 0.5.  Repeated rows are scored
each; an empty table gives an empty result; other columns are not read by ``scores`` and
carried along by ``with_scores``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import BUCKETS, narrow
from quadrant.session import materialize

CHUNK = 256             # bytes compressed at a time
PIECE, PIECES = 512, 64  # bytes of a training piece, and pieces of one document at most
DICTIONARY = 112_640    # bytes of a dictionary
SAMPLE = 1_000          # documents a class, for the dictionaries and again for the calibration
LEVEL = 3
TASKS = 32              # tasks that the chosen documents are dealt to
TILT = 0.02             # the logistic curve's part of a score


@dataclass
class Model:
    """Dictionaries (None: compress without), the isotonic curve's points and the logistic curve."""

    good: bytes | None
    bad: bytes | None
    slope: float = 0.0
    intercept: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def probability(self, feature: np.ndarray) -> np.ndarray:
        smooth = 1 / (1 + np.exp(-np.clip(self.slope * feature + self.intercept, -500, 500)))
        if self.steps is None:
            return smooth
        return (1 - TILT) * np.interp(feature, *self.steps) + TILT * smooth


class Compressors:
    """A model's two compressors, made once per task."""

    def __init__(self, model: Model):
        self.good, self.bad = (self._make(d) for d in (model.good, model.bad))

    @staticmethod
    def _make(dictionary: bytes | None):
        import zstandard

        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if not dictionary:
            return zstandard.ZstdCompressor(**options)
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, **options)

    def feature(self, text: str | None) -> float:
        raw = (text or "").encode()
        if not raw:
            return 0.0
        good, bad = self.good.compress, self.bad.compress
        saved = 0
        for at in range(0, len(raw), CHUNK):
            chunk = raw[at:at + CHUNK]
            saved += len(bad(chunk)) - len(good(chunk))
        return saved / len(raw)


def _dictionary(pieces: list[bytes]) -> bytes | None:
    """A trained dictionary; of too few pieces, their plain content."""
    import zstandard

    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def _fit(feature: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with one feature, by Newton's method; targets are
    smoothed as for counts, so that separable classes have a finite slope."""
    scale = feature.std() or 1.0
    x = np.stack([feature / scale, np.ones(len(feature))], axis=1)
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-9]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge @ w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / scale, w[1]


def _isotonic(feature: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve of label 1's share, as points: neighbouring stretches whose shares
    fall are pooled.  A stretch's share is drawn to one half by the weight of one row."""
    stretches: list[list[float]] = []  # weight, weight of label 1, weight x feature
    for k in np.argsort(feature, kind="stable"):
        stretches.append([weight[k], weight[k] * label[k], weight[k] * feature[k]])
        while len(stretches) > 1 and stretches[-2][1] * stretches[-1][0] >= stretches[-1][1] * stretches[-2][0]:
            last = stretches.pop()
            stretches[-1] = [a + b for a, b in zip(stretches[-1], last, strict=True)]
    pooled = np.array(stretches)
    one = weight.mean()
    share = (pooled[:, 1] + one / 2) / (pooled[:, 0] + one)
    return pooled[:, 2] / pooled[:, 0], np.maximum.accumulate(share)


def learn(documents: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the labels whose id meets ``usable`` (a condition on ``id``)."""
    marks = (narrow(labels, id=label_id, label=label).filter("id IS NOT NULL AND label IS NOT NULL").filter(usable)
             .groupBy("id").agg(F.avg("label").alias("mean")).filter("mean <> 0.5")
             .select("id", (F.col("mean") > 0.5).cast("int").alias("label")))
    count = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One half of the ids teaches the dictionaries, the other the curve.
    teaches = F.crc32(F.concat(F.lit("half "), F.col("id").cast("string")).cast("binary")) % 2 == 0
    share = F.lit(0.0)
    for k, n in count.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, 2 * sample / n))).otherwise(share)
    key = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(BUCKETS))
    chosen = materialize(marks.withColumn("teaches", teaches).filter(key < F.ceil(share * BUCKETS)).withColumnRenamed("id", "i"))
    # About 4 x sample ids by the choice above, whatever the number of labels: counted, then sent to the
    # documents, so that no text is shuffled.
    side = F.broadcast(chosen) if chosen.count() <= 8 * sample else chosen.hint("merge")
    # one row an id, however many documents carry it, so what comes to the driver is bounded by the ids
    rows = (narrow(documents, id=doc_id, text=text).join(side, F.col("id") == F.col("i"))
            .groupBy("i", "label", "teaches").agg(F.min("text").alias("text")).drop("i").repartition(TASKS))
    rows = materialize(rows)
    dictionaries = _pieces(rows.filter("teaches"))
    model = Model(*[_dictionary(dictionaries.get(k, [])) for k in (1, 0)])
    features = (with_scores(rows.filter("NOT teaches").select("label", "text"), model, raw=True)
                .select("label", "score").toPandas())
    if len(features):
        label_, n = features["label"].to_numpy(), features["label"].value_counts()
        weight = np.array([count[k] / n[k] for k in label_]) * len(label_) / sum(count[k] for k in n.index)
        model.slope, model.intercept = _fit(features["score"].to_numpy(float), label_, weight)
        model.steps = _isotonic(features["score"].to_numpy(float), label_, weight)
    return model


def _pieces(rows: DataFrame) -> dict[int, list[bytes]]:
    """Training pieces by label, in a stable order."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("piece", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, piece = [], []
            for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                step = max(PIECE, math.ceil(len(raw) / PIECES))
                cut = [raw[at:at + PIECE] for at in range(0, len(raw), step)]
                label += [k] * len(cut)
                piece += cut
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(piece, pa.binary())], ["label", "piece"])

    out: dict[int, list[bytes]] = {}
    found = rows.select("label", "text").mapInArrow(run, schema).toArrow()
    for k, p in sorted(zip(found.column("label").to_pylist(), found.column("piece").to_pylist(), strict=True)):
        out.setdefault(k, []).append(p)
    return out


def with_scores(documents: DataFrame, model: Model, text: str = "text", score: str = "score",
                raw: bool = False) -> DataFrame:
    """All columns, and the score (``raw``: the feature) under the given name."""
    at = documents.columns.index(text)
    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model)
        for batch in batches:
            found = np.array([compressors.feature(t.as_py()) for t in batch.column(at)], float)
            found = found if raw else model.probability(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], schema.names)

    return documents.mapInArrow(run, schema)


def scores(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    return with_scores(narrow(documents, doc_id=doc_id, text=text), model).select("doc_id", "score")
