"""Secret scan: keyword prefilter, anchored patterns near hits, checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the
lower-cased text; a kind's regular expression is then tried only at its keyword's
place, anchored there.  Hexadecimal runs have no keyword of their own: the text is
translated to character classes, in which such a run is itself a keyword
(``h`` as often as the shortest run).  Since a pattern begins with its keyword,
trying it at the hits from the left, beyond the end of the match before, gives
what a search over the whole text gives.

Kinds, in this order:

* ``assign``: a password, secret, token or API key assigned a value of 6+ characters;
* ``access``: ``AKIA...``, 20+ characters; ``hex``: 24+ lower-case hexadecimal digits;
* ``github`` and ``npm``: tokens that end in a checksum of their random part
  (CRC-32 in six base-62 digits); only those whose checksum holds are reported.

The texts are scanned as one byte a character (others than Latin-1 as ``?``, which
no pattern accepts), so positions are code points.

Defined results: a null text is empty and has no spans; a span is found per kind, leftmost
first and not overlapping its kind's others; spans of different kinds may overlap;
null or repeated ids and other columns do not matter; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrant.llm.common import narrow

# The kinds' keywords, patterns and shortest lengths, and the base-62 digits.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
            "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

HEX_CLASS = bytes(ord("h") if c in b"0123456789abcdef" else ord(".") for c in range(256))


def checksum_holds(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in base 62."""
    value = 0
    for digit in check:
        value = value * 62 + BASE62.index(digit)
    return value == zlib.crc32(body)


# kind -> (pattern anchored at the keyword, test of a match)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (GITHUB, lambda m: checksum_holds(m[1], m[2])),
    "npm": (NPM, lambda m: checksum_holds(m[1], m[2])),
}


class Scanner:
    """The automaton of all keywords."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, number of the kind) of every secret, by start then kind."""
        if not text:
            return []
        raw = text.encode("latin-1", "replace")
        hits: dict[str, list[int]] = {}
        for last, (kind, size) in self.automaton.iter(raw.lower().decode("latin-1")):
            hits.setdefault(kind, []).append(last - size + 1)
        out = []
        for kind, starts in hits.items():
            pattern, holds = RULES[kind]
            done = 0
            for start in sorted(starts):
                if start >= done and (m := pattern.match(raw, start)):
                    done = m.end()
                    if holds(m):
                        out.append((start, done, KINDS.index(kind)))
        classes = raw.translate(HEX_CLASS)
        start = classes.find(b"h" * HEX_LEAST)
        while start >= 0:
            end = HEX.match(raw, start).end()
            out.append((start, end, KINDS.index("hex")))
            start = classes.find(b"h" * HEX_LEAST, end)
        return sorted(out, key=lambda s: (s[0], s[2]))


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    """The scanner of a worker process."""
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def find_secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end): one row per document."""
    rows = narrow(documents, doc_id=doc_id, text=text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().spans
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan(value.as_py())]
                     for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], ["doc_id", "spans"])

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
