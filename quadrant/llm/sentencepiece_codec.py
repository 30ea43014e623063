"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words (a space and what follows it; no piece of a
vocabulary we accept crosses that border), every different word is encoded
once, and a text's ids are the concatenation of its words' ids.  Words are
encoded together: one flat array holds the symbols of all words.  Each round

1. takes the minimum pair rank of every word (a segmented minimum),
2. merges that pair at all its places in the word at once, the leftmost of
   overlapping places first,
3. compacts the array, ranks only the pairs that are new, and retires words
   without a mergeable pair.

Merging all places of a pair at once equals the library's one-at-a-time order
unless a merge makes a pair that ranks before the pair itself.  That depends on
the vocabulary only: pieces for which it is possible are found when the model
is loaded, and merged one place a round.

Texts are worked on in slices cut at word borders, and words are remembered up
to a bound, so memory does not grow with a text or a partition (but for one
text and its ids, which Spark holds as a row anyway).

Defined results: a null text is encoded as the empty text (begin and end ids
only), decoded text then is empty; ids and other columns may be null or
repeated, each row is encoded on its own; an empty table gives an empty result;
only the named columns are read.  Normalisation (dummy prefix, escaped spaces,
the model's character map) is the library's own.  Models with user-defined or
unused pieces, or with pieces that continue past a space, are refused.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.llm.common import narrow

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
SLICE = 1 << 20          # characters of one text worked on at a time
BATCH = 1 << 20          # characters of several texts worked on at a time
REMEMBERED = 150_000     # words remembered by a task
NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge


class Codec:
    """The vocabulary as arrays, and the merge rounds over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a vocabulary with unused pieces, or with pieces that cross a word border")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.byte_fallback = any(sp.is_byte(i) for i in range(n))
        # Symbols: piece ids, then characters that occur in pieces without being one, then (from
        # self.far on) any other character.
        symbol = {p: i for i, p in enumerate(pieces) if plain[i]}
        extra = sorted({c for p in symbol for c in p} - symbol.keys())
        symbol |= {c: n + k for k, c in enumerate(extra)}
        self.far = n + len(extra)
        self.char_symbol = np.arange(self.far, self.far + 0x110000, dtype=np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        self.extra_char = np.array([ord(c) for c in extra], np.int64)
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs: dict[int, int] = {}
        whole = {p for p, i in symbol.items() if i < n and len(p) > 1}
        one_by_one = np.zeros(n, bool)
        counts = np.bincount(order[[symbol[p] for p in whole]], minlength=order.max() + 1 if n else 1)
        for p in whole:
            i = symbol[p]
            one_by_one[i] |= counts[order[i]] > 1  # equal scores: strictly leftmost first
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is None or b is None:
                    continue
                pairs[a * self.far + b] = i
                for part in (a, b):
                    if part < n and order[i] <= order[part]:
                        one_by_one[part] = True
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), 0).astype(np.int32)
        self.rank = np.append(order[self.merged[:-1]], NONE).astype(np.int32) if len(keys) else np.array([NONE])
        self.one_by_one = one_by_one
        # What a piece decodes to.
        texts = [b"" if sp.is_control(i) else bytes([int(p[1:-1], 16)]) if sp.is_byte(i)
                 else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if 0 <= self.unk < n:
            texts[self.unk] = sp.decode([self.unk]).encode()
        self.text_flat = np.frombuffer(b"".join(texts), np.uint8)
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(self.text_len) - self.text_len
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.dummy = sp.encode("x")[:1] != [] and sp.normalize("x").startswith(SPACE)

    # ---- merge rounds ---------------------------------------------------------------
    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank and merged symbol of each (left, right)."""
        key = left.astype(np.int64) * self.far + right
        key[(left >= self.far) | (right >= self.far)] = -1
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NONE), np.where(found, self.merged[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words after each other, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.char_symbol[chars]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, into = self._ranked(sym, word)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            live = np.repeat(best != NONE, size)
            if not live.all():  # retire words without a mergeable pair
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, into = sym[live], word[live], rank[live], into[live]
                size, best = size[best != NONE], best[best != NONE]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == np.repeat(best, size))
            # Of overlapping places every other one, from the left.
            new_run = np.r_[True, np.diff(place) > 1]
            run_start = place[new_run][np.cumsum(new_run) - 1]
            place = place[(place - run_start) % 2 == 0]
            alone = self.one_by_one[into[place]]
            if alone.any():  # only the leftmost place of the word
                leftmost = np.r_[True, word[place[1:]] != word[place[:-1]]]
                place = place[~alone | leftmost]
            sym[place] = into[place]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            at = place - np.arange(len(place))  # where the merged symbols are after compaction
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            rank[fresh], into[fresh] = self._ranked_at(sym, word, fresh)
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        sym, word = self._fall_back(sym, word)
        return sym, np.bincount(word, minlength=len(words)).astype(np.int64)

    def _ranked(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranked_at(sym, word, np.arange(len(sym)))

    def _ranked_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank and merged symbol of the pairs that begin at the given places."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, into = self._pairs(sym[at], sym[nxt])
        rank[(nxt == at) | (word[nxt] != word[at])] = NONE
        return rank, into

    def _fall_back(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their bytes."""
        n = len(self.is_byte)
        odd = np.flatnonzero(sym >= n)
        if not len(odd):
            return sym, word
        chars = np.where(sym[odd] >= self.far, sym[odd].astype(np.int64) - self.far, 0)
        if len(self.extra_char):
            near = sym[odd] < self.far
            chars[near] = self.extra_char[sym[odd][near] - n]
        if not self.byte_fallback:  # a run of unknown characters is one unknown id
            sym[odd] = self.unk
            again = np.zeros(len(sym), bool)
            again[odd[1:]] = (odd[1:] == odd[:-1] + 1) & (word[odd[1:]] == word[odd[:-1]])
            return sym[~again], word[~again]
        raw = [chr(c).encode() for c in chars.tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(b) for b in raw]
        out, starts = np.repeat(sym, times), np.cumsum(times) - times
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        out[np.repeat(starts[odd], times[odd]) + _within(times[odd])] = flat
        return out, np.repeat(word, times)

    # ---- texts ----------------------------------------------------------------------
    def encode(self, texts: Iterable[str | None], memory: dict | None = None) -> Iterator[np.ndarray]:
        """The ids of each text (null: as empty), begin and end ids included."""
        memory = Memory(self) if memory is None else memory
        batch: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > SLICE:
                yield from self._encode_batch(batch, memory)
                batch, size = [], 0
                parts = [memory.ids([WORD.findall(x)])[0] for x in slices(self.sp.normalize(text))]
                yield self._framed(parts)
                continue
            batch.append(text)
            size += len(text) + 1
            if size >= BATCH:
                yield from self._encode_batch(batch, memory)
                batch, size = [], 0
        yield from self._encode_batch(batch, memory)

    def _framed(self, parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([np.array([self.bos], np.int32), *parts, np.array([self.eos], np.int32)])

    def _encode_batch(self, texts: list[str], memory: Memory) -> Iterator[np.ndarray]:
        if texts:
            for ids in memory.ids([WORD.findall(self.sp.normalize(t)) for t in texts]):
                yield self._framed([ids])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode: pieces after each other,
        begin and end ids silent, the dummy prefix dropped."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids != self.bos) & (ids != self.eos)]
        size = self.text_len[ids]
        raw = self.text_flat[np.repeat(self.text_start[ids], size) + _within(size)].tobytes()
        if self.dummy and raw[:1] == b" " and not self.is_byte[ids[:1]].any():
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8: the library's replacement rules
            return self.sp.decode(ids.tolist())


class Numbered(dict):
    """Words by number; a word not met before gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Memory:
    """The ids of words met before; starts anew when it holds too many."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self._clear()

    def _clear(self) -> None:
        self.index = Numbered()
        self.flat = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given its words."""
        if len(self.index) > REMEMBERED:
            self._clear()
        known = len(self.index)
        codes = [np.array(list(map(self.index.__getitem__, words)), np.int64) for words in texts]
        if len(self.index) > known:
            flat, count = self.codec.encode_words(list(itertools.islice(self.index, known, None)))
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        start = np.cumsum(self.count) - self.count
        out = []
        for code in codes:
            size = self.count[code]
            out.append(self.flat[np.repeat(start[code], size) + _within(size)])
        return out


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... of each run of the given sizes."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A normalised text in slices that end at word borders."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and not (text[end] == SPACE and text[end - 1] != SPACE):
            found = text.find(SPACE, end if text[end] != SPACE else end + 1)
            end = len(text) if found < 0 else found
        yield text[start:end]
        start = end


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, loaded once per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (text decoded from the ids)."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        memory = Memory(c)
        for batch in batches:
            for at, part in _parts(batch):
                ids = list(c.encode(part, memory))
                offsets = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                     pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def digests(documents: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (UTF-8): what ``encode`` gives, digested beside
    the encoder so that ids and texts need not leave the task."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        memory = Memory(c)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for _, part in _parts(batch):
                for ids in c.encode(part, memory):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()),
                 pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, size: int = BATCH) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts, some characters at a time, with the row each part begins at."""
    column = batch.column(1)
    begin = 0
    part: list[str | None] = []
    held = 0
    for k in range(len(column)):
        value = column[k].as_py()
        part.append(value)
        held += len(value or "") + 1
        if held >= size:
            yield begin, part
            begin, part, held = k + 1, [], 0
    if part:
        yield begin, part
