"""Token counts of whole texts, huge ones by overlapping chunks.

A text longer than ``chunk`` characters (16,384: some hundredths of the given texts, a quarter of their bytes) is encoded in
overlapping chunks, with offsets.  Two neighbouring
chunks are spliced at a place inside their overlap that is stable in both: it
follows white space (so nothing before it can change what comes after), both
encodings begin a token there, and from there to the last white space of the
overlap they agree token by token.  Where an overlap holds no such place, it is
widened to the left, and beyond that the chunk is lengthened, at last to the whole
rest of the text; so the result never depends on chunk or overlap.

A text that one chunk covers is encoded as a whole.  Where the tokenizer's tokens never cross white space,
which is tried out when its file is loaded (``_space_separates``), that is done word by word, and a task encodes
each different word once; other tokenizers' short texts go to the library as they are.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text are handled as the library does by default; nothing is
truncated or padded; null or repeated ids and other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrant.llm.common import narrow

CHUNK, OVERLAP = 1 << 14, 1 << 6   # characters
REMEMBERED = 300_000               # words remembered by a task
JOINED = 2_000                     # words encoded by one call of the library
SPACES = " \t\n\r\x0b\x0c"


class TokenCounter:
    """Counts with one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A special string that always is one token of its own, to put between words.
        plain = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                 if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (plain[-1][0], plain[-1][1].content) if plain else (None, None)
        self.words: dict[bytes, int] = {}
        self.splices = 0  # boundaries that two chunks were spliced at
        self.by_word = self._space_separates()

    def _space_separates(self) -> bool:
        """Whether white space of every kind, between characters of every kind, splits a text into
        parts whose tokens are the text's tokens."""
        sides = ["a", "Z", "é", "ß", "я", "日", "1", "²", ".", ",", "'", "'s", "-", "_", "<|", "|>", "🙂", "\u0301", "&"]
        spaces = [*SPACES, "  ", "\r\n", " \n\t"]
        texts = [f"{x}{gap}{y}" for x in sides for y in sides for gap in spaces]
        encoded = self.tokenizer.encode_batch_fast(texts + sides, add_special_tokens=False)
        alone = dict(zip(sides, (e.ids for e in encoded[len(texts):]), strict=True))
        want = [alone[x] + alone[y] for x in sides for y in sides for _ in spaces]
        return all(e.ids == w for e, w in zip(encoded, want))

    # ---- word by word -------------------------------------------------------------
    def _encode_words(self, words: list[str]) -> list[int]:
        """How many tokens each word has."""
        if self.mark is None:
            return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        odd = {k for k, w in enumerate(words) if self.mark in w}
        counts = np.zeros(len(words), np.int64)
        for k in odd:
            counts[k] = len(self.tokenizer.encode(words[k], add_special_tokens=False))
        usual = [k for k in range(len(words)) if k not in odd]
        groups = [usual[k:k + JOINED] for k in range(0, len(usual), JOINED)]
        for k, group in enumerate(groups):
            joined = self.mark.join([words[i] for i in group])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            assert len(ends) == len(group)
            counts[group] = np.diff(np.append(-1, ends)) - 1
        return counts.tolist()

    def count_short(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text, by its words where that is right."""
        if not self.by_word:
            return [len(e) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.words) > REMEMBERED:
            self.words = {}
        known, split = self.words, [t.split() for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self._encode_words([w.decode() for w in fresh]), strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]

    # ---- overlapping chunks -------------------------------------------------------
    def _spans(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:end], and where each token begins in the text."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        begins = np.array([o[0] for o in e.offsets], np.int64) + start
        return np.array(e.ids, np.int64), begins

    @staticmethod
    def _splice(text: str, low: int, high: int, left: tuple, right: tuple) -> int | None:
        """A stable common boundary of two encodings that overlap in text[low:high]."""
        last = max(text.rfind(c, low, high) for c in SPACES)  # beyond it, the left chunk's end may cut a word
        if last < 0:
            return None
        for at in range(low + 1, last):
            if text[at - 1] not in SPACES or text[at] in SPACES:
                continue
            cut = [slice(*np.searchsorted(x[1], [at, last])) for x in (left, right)]
            ids, begins = zip(*[(x[0][c], x[1][c]) for x, c in zip((left, right), cut, strict=True)], strict=True)
            if len(begins[0]) and begins[0][0] == at and np.array_equal(*begins) and np.array_equal(*ids):
                return at
        return None

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text of any length, by overlapping chunks."""
        total, resume, end = 0, 0, min(len(text), chunk)
        left = self._spans(text, 0, end)
        begin = 0  # where the left chunk begins
        while end < len(text):
            wide, size, at = overlap, chunk, None
            while at is None:
                low = max(resume, end - wide)
                until = min(len(text), max(end + 1, low + size))
                right = self._spans(text, low, until)
                at = self._splice(text, low, end, left, right)
                if at is not None:
                    break
                if low > resume:  # widen the overlap
                    wide *= 2
                else:  # no boundary since the last one: a longer chunk from there
                    size *= 2
                    begin, end = low, until
                    left, wide = right, overlap
                    if end >= len(text):
                        break
            if at is None:
                break
            self.splices += 1
            total += int(np.searchsorted(left[1], at) - np.searchsorted(left[1], resume))
            begin, resume, end, left = low, at, until, right
        return total + int(len(left[1]) - np.searchsorted(left[1], resume))

    def count(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        raw = [t.encode() for t in texts]
        short = iter(self.count_short([b for t, b in zip(texts, raw, strict=True) if len(t) <= chunk]))
        tokens = [next(short) if len(t) <= chunk else self.count_long(t, chunk, overlap) for t in texts]
        return [len(b) for b in raw], tokens


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a tokenizer file, loaded once per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(documents: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                n_bytes, n_tokens = c.count([t or "" for t in batch.column(1).to_pylist()], chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                     pa.array([n > limit for n in n_tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)
