"""SentencePiece codec, token counts and secret scan against the libraries and plain searches."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm.fixtures import awkward, documents, empty
from tokenizers import Tokenizer

from quadrant.llm import secret_scan, sentencepiece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "b", "e", "th", " ", "  ", "\n", "▁", "é", "日本", "🙂", "\x00", "the", "ing", "tion", "'s", "1", "aaaa", "́",
        "ß", "ﬁ", "\t", "----", "</s>", "<0x0A>", "<unk>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "Σ", "İ", "가", "ᄀ", "ᅡ", "."]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_library(sp):
    codec = sentencepiece_codec.codec(MODEL)
    given = ["", None, " ", "  ", "a" * 3000, "ab" * 2000, " " * 500, *texts(3000, 60, 1)]
    for text, ids in zip(given, codec.encode(given), strict=True):
        assert ids.tolist() == [1, *sp.encode(text or ""), 2], text
        assert codec.decode(ids) == sp.decode(ids.tolist())


def test_codec_slices_and_forgets(sp, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "SLICE", 50)
    monkeypatch.setattr(sentencepiece_codec, "BATCH", 300)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 20)
    codec = sentencepiece_codec.codec(MODEL)
    given = [*texts(200, 90, 2), "no-space" * 200]
    monkeypatch.setattr(sentencepiece_codec.slices, "__defaults__", (50,))
    assert [x.tolist() for x in codec.encode(given)] == [[1, *sp.encode(t), 2] for t in given]


def test_decode_of_any_ids(sp):
    codec = sentencepiece_codec.codec(MODEL)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids)) == sp.decode(ids)


def test_codec_on_awkward_rows(spark, sp):
    docs = awkward(spark)
    want = sorted(((r.doc_id, [1, *sp.encode(r.text or ""), 2]) for r in docs.collect()), key=str)
    got = sentencepiece_codec.encode(docs, MODEL).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert sorted((r.decoded for r in got)) == sorted(r.text or "" for r in docs.collect())
    found = {r.ids_sha256 for r in sentencepiece_codec.digests(docs, MODEL).collect()}
    assert found == {hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for _, i in want}
    assert sentencepiece_codec.digests(empty(spark), MODEL).count() == 0


def test_counts_equal_library():
    library = Tokenizer.from_file(WORDS)
    counter = token_counts.TokenCounter(WORDS)
    given = ["", "a" * 2000, " " * 300, *texts(1500, 150, 3)]
    want = [len(e) for e in library.encode_batch(given, add_special_tokens=False)]
    assert counter.count(given)[1] == want
    for chunk, overlap in ((16, 4), (50, 8), (7, 3)):
        assert [counter.count_long(t, chunk, overlap) for t in given[:400]] == want[:400]


def test_counts_on_awkward_rows(spark):
    library = Tokenizer.from_file(WORDS)
    docs = awkward(spark)
    got = token_counts.count_tokens(docs, WORDS, limit=100, chunk=2000, overlap=20).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty(spark), WORDS, limit=1).count() == 0


def plain_search(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        out += [(m.start(), m.end(), 0)] if len(m[2]) >= 6 else []
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets_equal_plain_search():
    bits = ["token", "TOKEN", "passwd", "Secret", "api_key", "apikey", '"', "'", " ", ":", "=", "abc123", "AKIA", "AKIAABCDEF",
            "0123456789ABCDEF", "f00d" * 6, "0a", "é", "日", "\n", "Z", "KEY", "ſecret", "/+_."]
    rng, scan = random.Random(5), secret_scan.scanner()
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in scan.spans(text) if s[2] < 3] == plain_search(text), text


def test_checksums_decide():
    body = b"abcdefghijABCDEFGHIJ0123456789"
    value, check = zlib.crc32(body), ""
    for _ in range(6):
        check = chr(secret_scan.BASE62[value % 62]) + check
        value //= 62
    good = f"x ghp_{body.decode()}{check} y"
    assert secret_scan.scanner().spans(good) == [(2, 42, 3)]
    assert secret_scan.scanner().spans(good.replace(check, "000000")) == []
    assert secret_scan.redact(good, [(2, 42, 3)]) == "x [github] y"


def test_secrets_in_rows(spark):
    docs = documents(spark, ["é token = abcdef1 AKIA" + "Q" * 16, None, "", "nothing"])
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {0: [("assign", 2, 17), ("access", 18, 38)], 1: [], 2: [], 3: []}
    assert secret_scan.find_secrets(awkward(spark)).count() == awkward(spark).count()
    assert secret_scan.find_secrets(empty(spark)).count() == 0
