"""Language identification by language-bitmask n-gram filters.

Learning: letter n-grams (words in lower case, a space at each end) are counted
per language in a sample of labelled texts, of at most about ``SAMPLE`` documents a language.
A language *contains* an n-gram if it occurs ``LEAST`` times there and its share of the
language's n-grams is at least ``SHARE`` of its largest share in any language.
The n-grams go into a bit-sliced Bloom filter: a slot holds a bit for each language, and
an n-gram sets its languages' bits in ``HASHES`` slots.  Its size is fixed, whatever it
was learned from; that table is all that comes to the driver and goes to the tasks.

Prediction: the slots of an n-gram, combined by AND, give all languages that contain
it at once.  Counting set bits per language over a whole text gives hits; of n n-grams,
n*f would be hits by chance, where f is the language's rate of false positives (from how full its
slice of each hash function is), so the corrected share is (hits/n - f)/(1 - f).  The largest wins.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or
if nothing was learned; a text whose n-grams are all unknown gets the language with
most labelled documents, with score 0; ties go to the smaller name; the score is the winner's part
of all corrected shares.  Repeated rows and null ids are rows like others; an empty table gives
an empty result; columns not named are not read, and the label is read for learning only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import keep_below, narrow

ORDERS = (3, 4)
SLOTS = 1 << 21          # per hash function
HASHES = 2
SAMPLE = 2_000           # labelled documents a language
LEAST, SHARE = 3, 0.5
BATCH = 1 << 21          # characters worked on at a time
UNKNOWN = "und"
ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the n-grams' hashes, and which text each is from."""
    padded = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in padded])
    letter = _letters()[chars]
    keep = np.ones(len(chars), bool)  # a run of other characters counts as one space
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    chars, owner = np.where(letter, chars, 32)[keep].astype(np.uint64), owner[keep]
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for k in range(n):
            value += chars[k:k + m] * np.uint64(ODD[k])
            value ^= value >> np.uint64(31)
        value *= np.uint64(ODD[0])
        value ^= value >> np.uint64(32)
        inside = owner[:m] == owner[n - 1:]
        yield value[inside], owner[:m][inside]


def _in_parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts, some characters at a time, with the row each part begins at."""
    begin, part, held = 0, [], 0
    for k, text in enumerate(texts):
        part.append(text or "")
        held += len(part[-1])
        if held >= BATCH:
            yield begin, part
            begin, part, held = k + 1, [], 0
    if part:
        yield begin, part


class Filters:
    """The learned filters: languages, their rates of false positives, and a table of masks."""

    def __init__(self, languages: list[str], usual: int, slots: np.ndarray, masks: np.ndarray):
        """slots: number of a slot (of all hash functions); masks: a row a slot, a column for 64 languages."""
        self.languages, self.usual = languages, usual
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(t).bits or t is np.uint64)
        words = max(1, -(-len(languages) // 64))
        self.table = np.zeros((words, HASHES * SLOTS), kind)
        for w in range(words):
            self.table[w, slots] = masks[:, w].astype(kind)
        self.chance = np.ones(len(languages))
        for k, _ in enumerate(languages):
            bits = (self.table[k // 64] >> kind(k % 64)) & kind(1)
            for h in range(HASHES):
                self.chance[k] *= bits[h * SLOTS:(h + 1) * SLOTS].mean()

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language contains."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for value, owner in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            at = [((value >> np.uint64(21 * h)) & np.uint64(SLOTS - 1)).astype(np.int64) + h * SLOTS for h in range(HASHES)]
            for w, table in enumerate(self.table):
                found = table[at[0]]
                for a in at[1:]:
                    found &= table[a]
                for k in range(64 * w, min(len(self.languages), 64 * w + 64)):
                    bit = (found >> found.dtype.type(k % 64)) & found.dtype.type(1)
                    hits[:, k] += np.bincount(owner, weights=bit, minlength=len(texts))
        return total, hits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, hits = self.hits(texts)
        n = np.maximum(total, 1)[:, None]
        share = np.clip((hits / n - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        every = share.sum(axis=1)
        best = np.where(every > 0, share.argmax(axis=1), self.usual)
        score = np.where(every > 0, share.max(axis=1) / np.where(every > 0, every, 1), 0.0)
        letter = [bool(any(map(str.isalpha, t))) for t in texts]
        return ([self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)],
                [float(s) if ok else 0.0 for s, ok in zip(score, letter, strict=True)])


def learn(documents: DataFrame, label: str = "lang", doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Filters:
    """Filters from the labelled documents (rows with a null label are left out)."""
    rows = narrow(documents, doc_id=doc_id, text=text, label=label).filter("label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], 0, np.zeros(0, np.int64), np.zeros((0, 1), np.uint64))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    kept = F.lit(False)
    for lang in languages:
        kept = kept | ((F.col("label") == lang) & keep_below(F.col("doc_id"), sample / counts[lang]))
    chosen = rows.filter(kept).select("text", number[F.col("label")].alias("k"))
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("gram", T.LongType()),
                           T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.asarray(batch.column(1))
            for at, part in _in_parts(batch.column(0).to_pylist()):
                for value, owner in grams(part):
                    for k in np.unique(lang[at:at + len(part)]):
                        seen, n = np.unique(value[lang[at + owner] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))],
                            ["k", "gram", "n"])

    each = [F.sum(F.when(F.col("k") == k, F.col("n"))).alias(f"n{k}") for k in range(len(languages))]
    counted = chosen.mapInArrow(count, schema).groupBy("gram").agg(*each).persist()
    totals = counted.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]).first()
    part = [F.coalesce(F.col(f"n{k}") / F.lit(float(totals[f"n{k}"] or 1)), F.lit(0.0)) for k in range(len(languages))]
    top = F.greatest(*part) if len(part) > 1 else part[0]
    words = max(1, -(-len(languages) // 64))

    def mask(w: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(64 * w, min(len(languages), 64 * w + 64)):
            bit = (1 << (k % 64)) - (1 << 64 if k % 64 == 63 else 0)
            has = (F.col(f"n{k}") >= LEAST) & (part[k] >= F.lit(SHARE) * F.col("top"))
            out = out.bitwiseOR(F.when(has, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    slot = [F.shiftrightunsigned("gram", 21 * h).bitwiseAND(F.lit(SLOTS - 1)) + h * SLOTS for h in range(HASHES)]
    masks = [f"m{w}" for w in range(words)]
    filled = (counted.withColumn("top", top).select("gram", *[mask(w).alias(m) for w, m in enumerate(masks)])
              .filter(" OR ".join(f"{m} <> 0" for m in masks))
              .select(F.explode(F.array(*slot)).alias("slot"), *masks)
              .groupBy("slot").agg(*[F.bit_or(m).alias(m) for m in masks]).toArrow())
    counted.unpersist()
    usual = max(range(len(languages)), key=lambda k: counts[languages[k]])
    return Filters(languages, usual, np.asarray(filled.column("slot"), np.int64),
                   np.stack([np.asarray(filled.column(m), np.int64).view(np.uint64) for m in masks], axis=1))


def predict(documents: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score = [], []
            for _, part in _in_parts(batch.column(1).to_pylist()):
                a, b = model.predict(part)
                lang += a
                score += b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
